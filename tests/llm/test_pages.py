import html
import re

from dayspan.llm import html_text

SITE = """<!doctype html><html><head><title>T &amp; t</title><style>p{{}}</style></head><body class="page">
<header><h1>Site name</h1></header><div id="main-menu"><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></div>
<div class="cookie-notice"><p>We use cookies, and we tell you at some length that we do so.</p></div><div class=wrap>{article}
<aside><p>Side text that is not short at all, but still beside the matter.</p></aside></div>
<form action=x><p>Your name <input name=a></p></form>
<section id="comments"><article><p>A reader writes a long comment, longer than any paragraph of the article itself.</p></article></section>
<footer>&copy; foot</footer><script>if (a < b) document.write("<p>no</p>")</script></body></html>"""
ARTICLE = """<div class="post"><h2>Title</h2><p>First para with <a href=x>a link</a> and &eacute;&nbsp;text&#33; that is long enough.<p>Second  para<br>after break
<ul><li>item one<li>item <b>two</b></ul><table><tr><td>c1<td>c2</table><div class="advert">Buy now</div><!-- no --><p>Third one &lt;p&gt;.</p></div>"""
TEXT = "Title\nFirst para with a link and é text! that is long enough.\nSecond para after break\nitem one\nitem two\nc1\nc2\nThird one <p>."


def test_parts_that_are_left_out():
    assert html_text.main_text(SITE.format(article=ARTICLE)) == TEXT
    assert html_text.main_text(SITE.format(article=ARTICLE.replace('<div class="post">', "<article>").replace("</p></div>", "</p></article>"))) == TEXT


def test_odd_pages():
    page = html_text.main_text
    assert page(None) == page("") == page("<p></p><script>x") == page("<!-- <p>x</p>") == page("<nav><p>x</nav>") == ""
    assert page("just text") == "just text"
    assert page("<p>a < b & c &notit; &#x41;</p>") == "a < b & c ¬it; A"
    assert page("<article><p>x</b></div></article>") == "x"
    assert page("<article>one<p>two</article>") == "one\ntwo"
    assert page("<article><p>" + "<b>x" * 3000 + "</article>") == "x" * 3000
    assert page("<article>" + "<div>" * 3000 + "deep" + "</article>") == "deep"
    assert page("<article><p>" + "word " * 50_000 + "</p></article>") == ("word " * 50_000).strip()


def paragraphs(name, n=4):
    return [f"Paragraph {i} of the {name} part tells its readers something of some length, so that its density counts." for i in range(n)]


def marked(rows):
    return "".join(f"<p>{r}</p>" for r in rows)


def test_threshold_decides_beside_an_article():
    one, two, lede = paragraphs("first"), paragraphs("second", 5), "A lede that stands before the article and is itself as long as one of the paragraphs that follow it."
    links = "<ul>" + "".join(f"<li><a href=/{i}>Another page of this site, number {i}</a></li>" for i in range(9)) + "</ul>"
    whole = "\n".join([lede, *one, *two])
    for tag in ("article", "div", "section"):
        a, b = f"<{tag}>{marked(one)}</{tag}>", f"<{tag}>{marked(two)}</{tag}>"
        assert html_text.main_text(f"<body><p>{lede}</p>{a}{b}{links}<p>Short</p></body>") == whole
        assert html_text.main_text(f"<body><x-page><p>{lede}</p>{a}<div>{b}{links}</div></x-page>{links}</body>") == whole
    assert html_text.main_text(f"<body>{links}<main>{marked(one)}</main><p>Short</p></body>") == "\n".join(one)


def test_names_never_remove_most_of_the_text():
    rows, page = paragraphs("main", 6), html_text.main_text
    side = '<div class="sidebar"><p>Text of the side part.</p></div><div class="cookie-notice"><p>We use cookies here.</p></div>'
    for name in ("content with-sidebar", "no-sidebar", "has-toc", "post social-share", "sidebar-layout", "widget", "comments"):
        for tag in ("div", "section"):
            assert page(f'<body><{tag} class="{name}"><h1 class="page-header">Title</h1>{marked(rows)}{side}</{tag}></body>') == "\n".join(["Title", *rows]), name
            assert page(f'<body>{side}<article><{tag} id="{name}">{marked(rows)}</{tag}></article></body>') == "\n".join(rows), name
    parts = "".join(f'<div class="x-widget x-widget-text"><p>{r}</p></div>' for r in rows)
    assert page(f"<body><div>{parts}{side}</div></body>") == "\n".join(rows)
    assert page(f'<body><div><div class="page-header"><h1>Title</h1></div>{marked(rows)}</div></body>') == "\n".join(["Title", *rows])
    assert page(f'<body><div class="post"><div class="has-toc"><p>{rows[0]}</p></div>{marked(rows[1:])}</div></body>') == "\n".join(rows)
    assert page('<body><div class="ad">An advert that is longer than the article.</div><div class="ad">And one more of those.</div><article><p>Few words.</p></article></body>') == "Few words."
    links = '<div class="{}"><a href=/a>One page</a> <a href=/b>Another page</a></div>'
    for name in ("page-header", "header", "social-share", "nav"):
        assert page(f"<body><article>{links.format(name)}{marked(rows)}</article></body>") == "\n".join(rows)


def test_whole_table_against_markup(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.row.page_id: (r.text, r.n_chars) for r in html_text.extract(pages, "html").collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        rows = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in rows if b)
        assert got[r.page_id] == (want, len(want))


def test_nulls_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "<p>hi</p>", None)], "page_id long, html string, text string")
    assert {r.row.page_id: r.text for r in html_text.extract(df, "html").collect()} == {1: "", 2: "hi"}
    assert html_text.extract(df.limit(0), "html").count() == 0
