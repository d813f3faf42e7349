"""Main text of web pages by composite text density.

A page becomes a tree of elements; scripts, styles, forms, navigation, headers, footers and
asides (by element or role) and hidden parts are left out of it. Whole words of class and id
name further sidebars, notices, adverts and reader comments. A named part is left out if its
share of the page's text bears the name out: never if it holds most of the characters outside
links (but for bare text in a box of its own beside an <article> or <main>), nor if all parts
of that word together do. "no-sidebar" or "has-toc" name nothing, and
a page header is named only where links prevail in it. Each node has its characters per tag, adjusted for characters and tags
in links, and the sum of its children's densities. The node with the largest sum is the article,
or the nearest <article> or <main> around it; the least density on the path from it to the body
is the threshold that any further part outside it must reach to belong to the text as well,
at whatever depth: a paragraph, list, table or heading, or a container of such (also another
<article>); bare text in a box of its own does not.

The text of the chosen subtrees is cut into blocks: white space in a block is one space,
line breaks are white space, blocks are joined by a line feed in page order. A null, empty
or tag-only page has an empty text. Unclosed and wrongly nested elements are closed the way
browsers do for paragraphs, list items, table parts and headings.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from dayspan.llm.rowscan import scan

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCK - frozenset("body html legend li dd dt td th tr tbody thead tfoot caption option optgroup summary".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("caption", "colgroup"),
}
SCOPE = {
    "li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",),
    "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "thead": ("table",),
}
# Parts of a page that are not its article; OUT_WORDS and HEADERS only where the part's text agrees.
OUT_TAGS = frozenset(
    "head script style noscript template nav header footer aside form menu iframe object embed applet canvas svg math video audio picture"
    " button select textarea input dialog search datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot banner banners sponsor sponsored sponsors promo promos promotion"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer foot masthead topbar"
    " comment comments respond disqus replies notice notices cookie cookies consent gdpr popup modal overlay toast newsletter subscribe subscription"
    " signup login share sharing social related recommended recommendations widget widgets toc skip copyright".split())
OWN_TEXT = frozenset("p li ul ol dl dd dt blockquote table caption tbody thead tfoot tr td th pre h1 h2 h3 h4 h5 h6 figure figcaption".split())
HEADERS = frozenset(("header", "site-header", "page-header", "siteheader", "pageheader"))
LINKED = frozenset(("page-header", "pageheader"))  # these may hold the title
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MODIFIERS = frozenset("no not non has with without".split())  # what follows them tells of the page, not of the part

_markup = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_attribute = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_word = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "words")

    def __init__(self, tag: str, parent: "Node | None", words: frozenset[str] = frozenset()):
        self.tag, self.parent, self.parts, self.words = tag, parent, [], words


def _values(attributes: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _attribute.finditer(attributes)}


def _left_out(tag: str, attributes: str) -> bool:
    if tag in OUT_TAGS:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    if tag in ("html", "body", "article", "main"):
        return False
    values = _values(attributes)
    if values.get("role") in OUT_ROLES or values.get("aria-hidden") == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _attribute.sub(" ", attributes)))


def _words(tag: str, attributes: str) -> frozenset[str]:
    """Words of class and id that may name a part beside the article."""
    if "=" not in attributes or tag in ("html", "body", "article", "main"):
        return frozenset()
    values, found = _values(attributes), set()
    for name in f"{values.get('class', '')} {values.get('id', '')}".split():
        if name in HEADERS and tag not in HEADINGS:
            found.add(name)
        for w in _word.findall(name):
            if w in MODIFIERS:
                break
            if w in OUT_WORDS:
                found.add(w)
    return frozenset(found)


def parse(page: str) -> Node:
    """The body's tree without the parts that are left out."""
    root = node = Node("body", None)
    depth_out: list[str] = []  # open elements inside a part that is left out
    named = False

    def text(data: str) -> None:
        if data and not depth_out:
            node.parts.append(html.unescape(data) if "&" in data else data)

    def close(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        nonlocal node
        at, found = node, None
        while at is not root and at.tag not in scope:
            if at.tag in names:
                found = at
            at = at.parent
        if found is not None:
            node = found.parent

    place, end = 0, len(page)
    while place < end:
        m = _markup.search(page, place)
        if m is None:
            text(page[place:])
            break
        text(page[place:m.start()])
        place = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:-3].replace("&", "&amp;"))
            continue
        if m[1]:  # an end tag
            if depth_out:
                if tag in depth_out:
                    while depth_out.pop() != tag:
                        pass
                elif tag in ("body", "html"):
                    depth_out.clear()
                continue
            at = node
            while at is not root and at.tag != tag:
                if tag not in BLOCK and at.tag in BLOCK:
                    at = root  # an inline end tag does not close blocks
                    break
                at = at.parent
            if at is not root:
                node = at.parent
            continue
        own_end = m[3].endswith("/") and tag not in BLOCK
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, place)
            close_at = page.find(">", stop.start()) if stop else -1
            inner = page[place:stop.start()] if stop else page[place:]
            place = close_at + 1 if close_at >= 0 else end
            if tag == "xmp":
                text(inner.replace("&", "&amp;"))
            continue
        if depth_out:
            if tag not in VOID and not own_end:
                if tag in CLOSES and depth_out[-1] in CLOSES[tag]:
                    depth_out.pop()
                elif tag in ENDS_P and depth_out[-1] == "p" and len(depth_out) > 1:
                    depth_out.pop()
                depth_out.append(tag)
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P:
            close(("p",), ("button", "table", "td", "th", "caption", "object"))
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE.get(tag, ()))
        if tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6") and node.tag[0] == "h" and node.tag[1:].isdigit():
            node = node.parent
        if tag in VOID:
            if tag not in OUT_TAGS:
                child = Node(tag, node)
                node.parts.append(child)
            continue
        if _left_out(tag, m[3]):
            if not own_end:
                depth_out.append(tag)
            node.parts.append(Node("#gap" if tag in BLOCK or tag == "dialog" else "#cut", node))
            continue
        child = Node(tag, node, _words(tag, m[3]))
        named = named or bool(child.words)
        node.parts.append(child)
        if not own_end:
            node = child
    if named:
        leave_out(root)
    return root


def _bare_box(node: Node) -> bool:
    """A block beside every article or main element that holds bare text and no further block."""
    if node.tag not in BLOCK or node.tag in OWN_TEXT or any(n.tag in BLOCK for n in _ordered(node)[1:]):
        return False
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is None


def leave_out(root: Node) -> None:
    """Cuts the named parts whose share of the page's text bears their name out."""
    nodes = count(root)
    most = (root.chars - root.link_chars) / 2
    marked = any(n.tag in ("article", "main") and n.chars for n in nodes)
    held: dict[str, int] = {}  # characters outside links below each word, parts that hold most of the page not counted
    above = {id(root): root.words}
    for n in nodes[1:]:
        own, outer = n.chars - n.link_chars, above[id(n.parent)]
        small = n.words if own <= most and not (marked and _bare_box(n)) else frozenset()
        above[id(n)] = outer | small if small else outer
        for w in small - outer:
            held[w] = held.get(w, 0) + own
    stack = [root]
    while stack:
        node = stack.pop()
        for i, n in enumerate(node.parts):
            if not isinstance(n, Node):
                continue
            own, linked = n.chars - n.link_chars, n.link_chars * 2 >= n.chars
            out = bool(n.words - LINKED) and marked and _bare_box(n)
            if out or own <= most and any(linked or (w not in LINKED and held.get(w, 0) <= most) for w in n.words):
                node.parts[i] = Node("#gap" if n.tag in BLOCK else "#cut", node)
            else:
                stack.append(n)


def _ordered(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out = [root]
    for node in out:
        out += [p for p in node.parts if isinstance(p, Node)]
    return out


def count(root: Node) -> list[Node]:
    """Sets characters and tags of all nodes; parents first."""
    nodes = _ordered(root)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for p in node.parts:
            if isinstance(p, str):
                node.chars += len("".join(p.split()))
            else:
                node.chars += p.chars
                node.tags += p.tags + (p.tag[0] != "#")
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags + (p.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    return nodes


def measure(root: Node) -> list[Node]:
    """Sets counts, densities and density sums of all nodes; parents first."""
    nodes = count(root)
    share = root.link_chars / max(1, root.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        if c == 0:
            node.density = 0.0
        else:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * math.log(c / max(1, lc) * t / max(1, lt) + 1) / max(1.0, math.log(base + math.e - 1))
        node.total = sum(p.density if isinstance(p, Node) else float(len("".join(p.split()))) for p in node.parts)
    return nodes


def _best(node: Node) -> Node:
    """The node of a subtree with the largest density sum; of equal ones the uppermost."""
    best = node
    for n in _ordered(node):
        if n.total > best.total and n.tag in BLOCK:
            best = n
    return best


def article_nodes(root: Node) -> list[Node]:
    """The chosen subtrees in page order, none inside another."""
    measure(root)
    if not root.chars:
        return []
    top = _best(root)
    while top.parent is not None and top.tag in OWN_TEXT:  # a paragraph is part of its container
        top = top.parent
    at = top
    while at.parent is not None:
        if at.tag in ("article", "main"):
            top = at
            break
        at = at.parent
    limit, at = top.density, top
    while at is not None:
        limit = min(limit, at.density)
        at = at.parent
    if top is root:
        return [top]
    chosen, path, at = [top], set(), top
    while at is not None:
        path.add(id(at))
        at = at.parent
    stack = [root]
    while stack:
        node = stack.pop()
        for p in node.parts:
            if not isinstance(p, Node) or p is top:
                continue
            if id(p) not in path and p.tag in BLOCK and p.density >= limit and p.link_chars * 2 < p.chars and (
                    p.tag in OWN_TEXT or any(isinstance(x, Node) and x.tag in BLOCK for x in p.parts)):
                chosen.append(p)
            else:  # a part that reaches the threshold may lie in one that does not
                stack.append(p)
    place = {id(n): i for i, n in enumerate(_depth_first(root))}
    return sorted(chosen, key=lambda n: place[id(n)])


def _depth_first(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, in page order."""
    out, line = [], []

    def flush():
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [node]
    while stack:
        p = stack.pop()
        if p is None:
            flush()
        elif isinstance(p, str):
            line.append(p)
        elif p.tag == "br":
            line.append("\n")
        elif p.tag == "#gap" or p.tag == "hr":
            flush()
        elif p.tag in BLOCK:
            flush()
            stack.append(None)
            stack += reversed(p.parts)
        else:
            stack += reversed(p.parts)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page; empty if there is none."""
    if not page:
        return ""
    return "\n".join(b for node in article_nodes(parse(page)) for b in blocks(node))


def extract(pages: DataFrame, column: str) -> DataFrame:
    """(row, text, n_chars): ``row`` holds the page's columns."""

    def work():
        def step(texts: pa.Array) -> list[pa.Array]:
            found = [main_text(x.as_py()) for x in texts]
            return [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]

        return step

    return scan(pages, column, "text string, n_chars long", work)
