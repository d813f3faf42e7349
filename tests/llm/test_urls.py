import random

from dayspan.llm import urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("a.example.org", "", "block"), ("EXAMPLE.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("b.com", "/fr/", "block"), ("x-b.com", "/", "block"), ("org", "/", "allow"), ("tie.net", "/q", "allow"), ("tie.net", "/q", "block"), (None, "/", "block"), ("", "/", "block"), ("nul.net", None, "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host, rest = (rest[:ends[0]], rest[ends[0]:]) if ends else (rest, "")
    path = rest
    for i, c in enumerate(rest):
        if c in "?#":
            path = rest[:i]
            break
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def judged(url):
    host, path = split(url)
    fits = []
    for h, p, v in RULES:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v, h + p))
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_equals_brute_force(spark):
    rng = random.Random(4)
    hosts = ["org", "example.org", "a.example.org", "z.a.example.org", "xexample.org", "com", "b.com", "x-b.com", "c.b.com", "a.x-b.com", "tie.net", "nul.net", "é.org", "a..org", "org.", "Example.ORG", ".com", "org:80", "-.org"]
    paths = ["", "/", "/es/", "/es", "/es/x", "/en/1", "/en/12", "/fr/", "/de/", "/q", "/q?/fr/", "?/es/", "#/", "/fr/é#x?y"]
    pages = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(700)]
    pages += [None, "", "no scheme", "://", "x://", "a://b://c.org/", "http://org/" + "y" * 100_000, "HTTP://ORG/\n/"]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(pages)], "page_id int, url string, host string, verdict string").repartition(5)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.judge(df, "url", rules, "allow").collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(pages[r.page.page_id]), pages[r.page.page_id]
        assert r.page.host == "h"


def test_no_rules_no_pages(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id int, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r.verdict for r in urls.judge(df, "url", none, "block").collect()] == ["block"]
    assert urls.judge(df.limit(0), "url", none, "block").count() == 0
