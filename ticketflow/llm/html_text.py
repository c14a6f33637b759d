"""Main text of web pages by composite text density.

Each page becomes a small DOM.  Elements that are never article text (scripts,
styles, menus, footers, form controls, adverts by class or id, hidden elements and those
of such a role) are taken out.  A form, or an element whose class or id names a
sidebar, notice, comment list and the like, goes if it also is no running text:
mostly links, sparser than the page's body, or outside of the article if the
page marks one.  For every other node the characters per tag, adjusted for the characters and tags inside
links, give its density; the node whose children's densities have the largest
sum is the main subtree.  Its innermost ``article`` or ``main`` ancestor
stands for it if there is one; otherwise siblings of the subtree whose density
reaches the smallest density on the path from the subtree to the body belong
to it too.  Inside it only link lists below that threshold are left out.

The text of the main nodes is cut into blocks at block-level tags; character
references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined in page order by an empty line.

A page is judged alone in one row of a vectorised UDF; no shuffle.  Defined
results: a null or empty page, or one without text, gives ''; repeated rows
give repeated results; broken markup is closed as browsers do in the common
cases (implied ends of p, li, table cells; unknown end tags ignored).
"""

from __future__ import annotations

import re
from html import unescape
from math import e as E
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKENS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset((
    "address article aside blockquote body br-block caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search "
    "section summary table tbody td tfoot th thead tr ul").split())
DROPPED = frozenset((
    "script style noscript template head title meta link nav menu aside footer button select option textarea "
    "input label fieldset iframe object embed applet canvas svg math audio video map dialog search "
    "noembed noframes xmp").split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
                  "toolbar tablist status".split())
# words of a class or id that name something other than the article
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
NAMES = ADVERTS | frozenset((
    "banner sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs toolbar topbar pagination pager "
    "footer foot masthead cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login signin form search share sharing social "
    "related recommended recommendations comment comments disqus respond reply replies widget widgets "
    "copyright legal skip hidden").split())
LAYOUT = frozenset("has no with without".split())    # the next word of a class or id names what a page has or lacks
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption",
                    "option", "legend", "summary", "figcaption"}
IMPLIED = {  # a start tag ends these open elements up to the boundary
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
SCOPE = frozenset("table td th caption body html article section main".split())
LINK_LIST = 0.5     # share of link characters above which a sparse block is a link list


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density",
                 "density_sum", "keeps")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.density_sum = 0.0
        self.keeps = False


def parse(html: str) -> tuple[Node, list[Node]]:
    """(root, nodes in page order; a parent comes before its children)."""
    root = Node("#root", "", None)
    nodes = [root]
    at, stack, n = 0, [root], len(html)
    pos = 0
    while True:
        m = TOKEN.search(html, pos)
        text = html[at:m.start() if m else n]
        if text:
            stack[-1].children.append(unescape(text))
        if not m:
            return root, nodes
        pos = at = m.end()
        if m["cdata"] is not None:
            stack[-1].children.append(m["cdata"])
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            depth = len(stack) - 1
            stop = SCOPE if tag not in SCOPE else ()
            while depth and stack[depth].tag != tag and stack[depth].tag not in stop:
                depth -= 1
            if depth and stack[depth].tag == tag:
                del stack[depth:]
            continue
        if tag in CLOSES_P:
            _imply(stack, {"p"}, SCOPE)
        if tag in IMPLIED:
            _imply(stack, *IMPLIED[tag])
        node = Node(tag, m["attrs"], stack[-1])
        stack[-1].children.append(node)
        nodes.append(node)
        if tag in VOID or m["attrs"].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, pos)
            stop_at = end.start() if end else n
            node.children.append(html[pos:stop_at])
            pos = at = stop_at
        stack.append(node)


def _imply(stack: list[Node], ended: set, boundary) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        tag = stack[depth].tag
        if tag in ended:
            # the outermost of the ended elements inside the boundary
            while depth > 1 and stack[depth - 1].tag in ended:
                depth -= 1
            del stack[depth:]
            return
        if tag in boundary:
            return


def _names(value: str, named: frozenset) -> bool:
    """Whether a class or id value holds one of the words that no layout word precedes."""
    for name in value.split():
        words = [x.lower() for x in TOKENS_OF_NAME.findall(name)]
        if any(x in named and before not in LAYOUT for before, x in zip(["", *words], words)):
            return True
    return False


def _named_away(node: Node, named: frozenset = NAMES) -> bool:
    return bool(node.attrs) and any(
        name.lower() in ("class", "id") and not (name.lower() == "id" and node.tag in HEADINGS) and _names(a or b or c, named)
        for name, a, b, c in ATTRIBUTE.findall(node.attrs))


def _hidden(node: Node) -> bool:
    """Hidden, or of a role that is never article text."""
    if not node.attrs:
        return False
    for name, a, b, c in ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), a or b or c
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _dropped(node: Node) -> bool:
    if node.tag in DROPPED:
        return True
    if node.tag == "header":    # a page header; an article's own header holds its title
        return not node.keeps and not any(a.tag in ("article", "main") for a in _ancestors(node))
    return node.tag not in ("#root", "html", "body", "main") and not node.keeps and (
        _hidden(node) or _named_away(node, ADVERTS))


def _ancestors(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


def _density(node: Node, body: Node) -> float:
    """Composite text density: characters per tag, less for text and tags in links."""
    c, t = node.chars, max(node.tags, 1)
    if not c:
        return 0.0
    lc, lt = node.link_chars, node.link_tags
    plain = max(c - lc, 1)
    base = log(c / plain * lc + body.link_chars / max(body.chars, 1) * c + E)
    inside = (c / max(lc, 1)) * (t / max(lt, 1))
    # the logarithm of ``inside`` to base ``base``; base >= 1, 1 only without links
    return c / t * (log(max(inside, 1.0 + 1e-9)) / log(base) if base > 1.0 + 1e-9 else log(max(inside, E)))


def _counted(nodes: list[Node], kept: set[int]) -> list[Node]:
    """The kept ones of the nodes, without their other children, with characters and tags counted."""
    alive = [x for x in nodes if id(x) in kept]
    for node in alive:
        node.children = [x for x in node.children if isinstance(x, str) or id(x) in kept]
        node.chars = node.tags = node.link_chars = node.link_tags = 0
    for node in reversed(alive):
        node.chars += sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    return alive


def main_nodes(root: Node, nodes: list[Node]) -> tuple[list[Node], float]:
    """(top nodes of the main text in page order, density threshold); drops what is not text.

    A node is not dropped for its name, or as a form, if it holds the page's article (or, in
    pages without one, a first-level heading).
    """
    held = [x for x in nodes if x.tag == "main" or (x.tag == "article" and not _named_away(x) and not _hidden(x))]
    for node in held or [x for x in nodes if x.tag == "h1"]:
        while node is not None and not node.keeps:
            node.keeps = True
            node = node.parent
    kept = {id(root)}
    alive = [root]
    for node in nodes[1:]:
        if id(node.parent) in kept and not _dropped(node):
            kept.add(id(node))
            alive.append(node)
    body = next((x for x in alive if x.tag == "body"), root)
    alive = _counted(alive, kept)
    suspects = [x for x in alive if x.tag not in ("#root", "html", "body", "main") and not x.keeps
                and (x.tag == "form" or _named_away(x))]
    least = _density(body, body)
    articles = {id(x) for x in held}
    # beside the page's article their text is not the article's
    gone = {id(x) for x in suspects if held and articles.isdisjoint(id(a) for a in _ancestors(x))
            or x.link_chars > LINK_LIST * x.chars or _density(x, body) < least}
    if gone:
        kept = {id(root)}
        for node in alive[1:]:
            if id(node.parent) in kept and id(node) not in gone:
                kept.add(id(node))
        alive = _counted(alive, kept)
    for node in reversed(alive):
        node.density = _density(node, body)
        if node.parent is not None:
            node.parent.density_sum += node.density
    inside = [x for x in alive if x is body or any(a is body for a in _ancestors(x))] if body is not root else alive
    best = max(inside, key=lambda x: x.density_sum)
    if not best.density_sum:      # text without any element
        best = body if body.chars else root
    path = [best]
    for a in _ancestors(best):
        path.append(a)
        if a is body:
            break
    threshold = min(x.density for x in path)
    # the innermost article or main that holds the subtree
    for x in path:
        if x.tag in ("article", "main"):
            return [x], threshold
    if best is body or best.parent is None:
        return [best], threshold
    tops = [x for x in best.parent.children if isinstance(x, Node)
            and (x is best or (x.chars and x.density >= threshold and x.link_chars <= LINK_LIST * x.chars))]
    return tops, threshold


def _blocks(node: Node, threshold: float, out: list[list[str]], top: bool = False) -> None:
    """Appends the text of a subtree; a block tag starts a new list.  Iterative: pages may nest deeply."""
    todo: list = [(node, top)]
    while todo:
        item = todo.pop()
        if item is None:
            out.append([])
            continue
        if isinstance(item, str):
            out[-1].append(item)
            continue
        x, is_top = item
        if x.tag == "br":
            out[-1].append(" ")
            continue
        block = x.tag in BLOCK
        if (block and not is_top and x.link_tags > 1 and x.density < threshold
                and x.link_chars > LINK_LIST * x.chars):
            out.append([])
            continue
        if block:
            out.append([])
            todo.append(None)
        todo.extend((c if isinstance(c, str) else (c, False)) for c in reversed(x.children))


def extract_text(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    tops, threshold = main_nodes(*parse(html))
    out: list[list[str]] = [[]]
    for node in tops:
        out.append([])
        _blocks(node, threshold, out, top=True)
    blocks = (" ".join("".join(x).split()) for x in out)
    return "\n\n".join(b for b in blocks if b)


def main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the column ``out`` (replaced if it exists): the main text of ``html``."""
    extract = F.pandas_udf(lambda pages: pages.map(extract_text), "string")
    return df.withColumn(out, extract(F.col(html)))


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.tables import table

    pages = main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
