"""Main text of HTML pages by composite text density.

The page becomes a tree (unclosed and stray tags mended), without scripts, forms, navigation and what its tag, role,
class or id says to be menu, advert, notice, sidebar or comments; a class or id counts as a whole, and not where the
page's only article or, without one, most of its text is.  Of an article's own header the headings stay.  Each node's density is its characters per tag,
lowered by the share of its characters and tags that are links; a node's sum is that of its children's densities, and
the node with the largest sum holds the text, an article around it included.  The least density on the path from it to
the body is the threshold: siblings along that path that reach it belong to the text as well, single blocks and text
that stands in the path's nodes themselves included, and so do the headings right before what belongs to it.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ._rows import add_columns

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
#: An attribute's name and value, if it has one; names are compared as a whole, values never searched for names.
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_DROPPED = frozenset("script style noscript template iframe textarea title head nav footer header aside form button select option input fieldset dialog menu svg canvas object audio video map".split())
_CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An open tag of the key ends an open one of the value, but not beyond one of _SCOPE.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = frozenset("table ul ol dl td th body html article section div main".split())
#: A whole class or id, alone or with a word that says what part of the page it is.
_BOILER = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|primary|secondary|global|header|footer)[_-])?(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|popup|modal|overlay|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe|subscription|signup|login|menu|nav|navbar|navigation|topnav|breadcrumbs?|sidebar|side-bar|widget\w*|"
    r"related|recommend\w*|share|sharing|social|comments?|disqus|respond|replies|reply|discussion|footer|masthead|pager|pagination|toolbar|tags?|meta|byline-links|skip|search|outbrain|taboola|copyright|legal|disclaimer)(?:[_-](?:s?box|bar|slot|unit|list|area|section|links?|buttons?|icons?|posts?|articles?|container|wrapper|wrap|form|menu|widget))?",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("chars", "children", "density", "gone", "link_chars", "link_tags", "named", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, gone: bool = False, named: bool = False):
        self.tag, self.parent, self.gone, self.named, self.children = tag, parent, gone, named, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _boilerplate(tag: str, attributes: str) -> bool:
    if tag in _DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
    return False


def _named(tag: str, attributes: str) -> bool:
    """Whether a class or id says that the element is boilerplate."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    return any(m[1].lower() in ("class", "id") and any(map(_BOILER.fullmatch, (m[2] or "").strip("\"'").split())) for m in _ATTRIBUTE.finditer(attributes))


def parse(page: str) -> Node:
    """The tree under a root; text is str, elements are Node, boilerplate nodes are there but marked gone."""
    root = Node("#root", None)
    at, top, end, names, titled = 0, root, len(page), False, []
    #: How many elements of a tag are open, so that a stray end tag needs no search.
    opened: dict[str, int] = {}

    def close_until(node: Node) -> Node:
        x = top
        while x is not node:
            opened[x.tag] -= 1
            x = x.parent
        opened[node.tag] -= 1
        return node.parent or root

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            top.children.append(page[at:])
            break
        if m.start() > at:
            top.children.append(page[at : m.start()])
        at = m.end() if m.end() > m.start() else m.start() + 1
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if not opened.get(tag):
                continue
            node = top
            while node is not root and node.tag != tag and not (tag in _INLINE and node.tag not in _INLINE):
                node = node.parent
            if node is not root and node.tag == tag:
                top = close_until(node)
            continue
        if tag in _CLOSES_P:
            node = top
            while node is not root and node.tag != "p" and (node.tag in _INLINE):
                node = node.parent
            if node.tag == "p":
                top = close_until(node)
        elif tag in _ENDS:
            node = top
            while node is not root and node.tag not in _ENDS[tag] and node.tag not in _SCOPE:
                node = node.parent
            if node.tag in _ENDS[tag]:
                top = close_until(node)
                while tag in ("tr", "tbody", "tfoot") and top.tag in _ENDS[tag]:
                    top = close_until(top)
        elif tag == "body" and top.tag == "head":
            top = close_until(top)
        of_article = tag == "header" and bool(opened.get("article"))
        node = Node(tag, top, top.gone or not of_article and _boilerplate(tag, m[3]), _named(tag, m[3]))
        if of_article and not node.gone:
            titled.append(node)
        names |= node.named
        top.children.append(node)
        if tag in _VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\s*>?", re.I).search(page, at)
            if stop:
                at = stop.end()
            elif tag not in ("title", "textarea"):
                at = end
            continue
        opened[tag] = opened.get(tag, 0) + 1
        top = node
    for node in titled:
        node.children = _titles(node)
    if names:
        _drop_named(root)
    return root


def _titles(header: Node) -> list[Node]:
    """The headings in an article's header; the rest of it goes as other headers do."""
    out, stack = [], list(reversed(header.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x.gone:
            continue
        if x.tag in _HEADINGS:
            x.parent = header
            out.append(x)
        else:
            stack += reversed(x.children)
    return out


def _drop_named(root: Node) -> None:
    """Marks what its name says to be boilerplate as gone, but not what holds its only articles or, without any, most of its text outside links."""
    order, stack, outside = [], [(root, False)], False
    while stack:
        node, within = stack.pop()
        order.append(node)
        within |= node.named
        outside |= node.tag in ("article", "main") and not within
        stack += [(c, within) for c in node.children if isinstance(c, Node) and not c.gone]
    plain, holds = {}, {}
    for node in reversed(order):
        below = [c for c in node.children if isinstance(c, Node) and not c.gone]
        plain[node] = 0 if node.tag == "a" else sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(plain[c] for c in below)
        holds[node] = node.tag in ("article", "main") or any(holds[c] for c in below)
    for node in order:
        node.gone |= node.parent is not None and node.parent.gone
        node.gone |= node.named and (outside or not (holds[node] or 2 * plain[node] > plain[root]))
    for node in order:
        if node.gone:
            for c in node.children:
                if isinstance(c, Node):
                    c.gone = True


def _count(node: Node) -> None:
    """Characters and tags of a node, its children's included."""
    for c in node.children:
        if isinstance(c, str):
            n = len(_SPACE.sub(" ", html.unescape(c)).strip()) if "&" in c else len(_SPACE.sub(" ", c).strip())
            node.chars += n
        elif not c.gone:
            node.chars += c.chars
            node.tags += c.tags + (c.tag != "br")
            node.link_chars += c.link_chars
            node.link_tags += c.link_tags
    if node.tag == "a":
        node.link_chars, node.link_tags = node.chars, node.link_tags + 1


def _density(node: Node, root: Node) -> float:
    c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + root.link_chars / max(1, root.chars) * c + math.e)
    return c / t * (math.log(c / max(1, lc) * t / max(1, lt)) / math.log(base) if lc and base > 1 and c * t > max(1, lc) * max(1, lt) else (1.0 if not lc else 0.0))


def _measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.gone]
    order.reverse()
    for node in order:
        _count(node)
    for node in order:
        node.density = _density(node, root)
        node.sum = sum(x.density for x in node.children if isinstance(x, Node) and not x.gone)
    return order


def _blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append(" ")
        elif not x.gone and (x.tag in _INLINE):
            stack += reversed(x.children)
        elif not x.gone:
            flush()
            stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def _parts(node: Node, whole: Node) -> list[Node]:
    """The blocks a node is made of, `whole` one of them; text and inline elements between them are blocks as well, of tag #run."""
    out: list[Node] = []
    for c in node.children:
        if isinstance(c, Node) and (c is whole or c.tag not in _INLINE and c.tag != "br"):
            if not c.gone:
                out.append(c)
            continue
        if isinstance(c, Node) and c.gone or isinstance(c, str) and not c.strip() and not (out and out[-1].tag == "#run"):
            continue
        if not (out and out[-1].tag == "#run"):
            out.append(Node("#run", node))
        out[-1].children.append(c)
    for x in out:
        if x.tag == "#run":
            _count(x)
    return out


def extract(page: str) -> str:
    """The page's main text: its blocks, two line feeds apart; empty if there is none."""
    root = parse(page)
    order = _measure(root)
    if not root.chars:
        return ""
    best = max(reversed(order), key=lambda x: (x.sum, x.density)) if any(x.sum for x in order) else root
    while best.parent is not None and (best.tag in _INLINE or best.tag == "p"):
        best = best.parent
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    beyond = ("html", "#root") if any(x.tag == "body" for x in path) else ()
    threshold = min(x.density for x in path if x is best or x.tag not in beyond)
    # An article around the best node is a hint: it stays whole, and the threshold chooses what stands beside it.
    best = next((x for x in path if x.tag == "article"), best)
    path = path[path.index(best) :]
    picked = [best]
    for below, node in zip(path, path[1:]):
        parts = _parts(node, below)
        at = next(k for k, x in enumerate(parts) if x is below)
        belongs = [k == at or (d := _density(x, root)) > 0 and d >= threshold for k, x in enumerate(parts)]
        for k in range(len(parts) - 2, -1, -1):
            belongs[k] |= belongs[k + 1] and parts[k].tag in _HEADINGS and _density(parts[k], root) > 0
        picked = [x for k, x in enumerate(parts[:at]) if belongs[k]] + picked + [x for k, x in enumerate(parts) if k > at and belongs[k]]
    return "\n\n".join(_blocks(picked))


def _extractor():
    def run(column: pa.Array) -> list[pa.Array]:
        texts = [extract(x) if x else "" for x in column.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]

    return run


def extract_text(df: DataFrame, page: str = "html") -> DataFrame:
    """df with text (string) and n_chars (long), without the page.

    Null, empty and textless pages give an empty text; pages may be of any length and depth, no rows give no rows.  Columns named like the added ones are replaced, all others stay;
    repeated rows get equal results.
    """
    return add_columns(df, [page], "text string, n_chars long", _extractor, drop=(page,))
