"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Each node's characters per tag are adjusted for the share of link text; the sum
of its children's densities marks the node that gathers most text directly.  That node's article, if it has one, is
the content; otherwise every subtree at least as dense as the sparsest node between it and the body gives its own
densest part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm.common import map_arrow, read, strings
from lagwise.llm.registry import query

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"']+)*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|(?P<text>[^<]+|<)""", re.S)
_UNENDED = re.compile(r"<[a-zA-Z/!?].*", re.S)
#: One attribute after the other, so that nothing inside a value is taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup; it is never text of the page.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes template".split())
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in _RAW}
_DROPPED = frozenset(
    "nav header footer aside form script style noscript template iframe object svg math canvas audio video button select "
    "option input textarea label fieldset menu dialog head title".split())
_BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td "
    "th figure figcaption hr address center details summary hgroup".split())
#: A start tag closes the open elements on the right, up to the border elements of their kind.
_CLOSES = {
    **{tag: ({"p"}, {"button", "td", "th", "table", "caption"}) for tag in _BLOCKS - {"li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "html", "body"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: A stray end tag of an inner element closes no container.
_INNER = frozenset("p li b i a span em strong".split())
_CONTAINERS = frozenset("article main section div table body".split())
#: Words of class, id and role that name what is not the article.
_SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion teaser teasers sidebar aside rail nav "
    "navigation navbar menu menubar breadcrumb breadcrumbs header masthead topbar footer colophon cookie cookies consent gdpr notice notices "
    "notification alert comment comments commentlist reply replies respond disqus discussion share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager toolbar search "
    "contentinfo complementary".split())
_COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Text of an article whose id is often a slug of its heading; only an id of side words alone says something of it.
_SLUGGED = frozenset("section p h1 h2 h3 h4 h5 h6".split())
#: Also names of an article's own sections.
_SECTION_WORDS = frozenset("discussion search notice notices header social".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(eq=False)
class Node:
    """An element: its children and texts in page order, and what lies below it."""

    tag: str
    side: bool = False
    comment: bool = False
    parent: Node | None = None
    children: list = field(default_factory=list)
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    links: int = 0
    size: int = 0
    main: bool = False
    article: bool = False
    heading: bool = False
    density: float = 0.0
    total: float = 0.0

    def elements(self) -> Iterator[Node]:
        return (c for c in self.children if isinstance(c, Node))


def _named(tag: str, attrs: str) -> Node:
    """A new element; ``side`` if its tag or names say that it isn't the article."""
    node = Node(tag, side=tag in _DROPPED)
    if attrs and not node.side:
        for name, value in _ATTRIBUTE.findall(attrs):
            name = name.lower()
            if name == "hidden" or name == "aria-hidden" and "true" in value.lower():
                node.side = True
            elif name in ("class", "id", "role"):
                words = {w.lower() for w in _WORD.findall(value)}
                if name == "id" and tag in _SLUGGED and not words <= _SIDE_WORDS - _SECTION_WORDS:
                    continue
                node.comment |= not words.isdisjoint(_COMMENT_WORDS)
                node.side |= not words.isdisjoint(_SIDE_WORDS)
    return node


class _Open:
    """The open elements, and how many of each tag they are, so that looking for one that isn't open costs nothing."""

    def __init__(self, root: Node) -> None:
        self.stack, self.count = [root], Counter()

    def push(self, node: Node, *, keep_open: bool = True) -> None:
        node.parent = self.stack[-1]
        self.stack[-1].children.append(node)
        if keep_open:
            self.stack.append(node)
            self.count[node.tag] += 1

    def close_from(self, i: int) -> None:
        for node in self.stack[i:]:
            self.count[node.tag] -= 1
        del self.stack[i:]

    def end(self, tag: str) -> None:
        """An end tag: closes its element and what is open inside; one of a paragraph or phrase leaves containers open."""
        if not self.count[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                return self.close_from(i)
            if tag in _INNER and self.stack[i].tag in _CONTAINERS:
                return None

    def make_room(self, tag: str) -> None:
        """A start tag closes what cannot hold it."""
        closed, borders = _CLOSES.get(tag, ((), ()))
        if not any(self.count[c] for c in closed):
            return
        lowest = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in borders:
                break
            if self.stack[i].tag in closed:
                lowest = i
                if closed == {"p"}:
                    break
        if lowest is not None:
            self.close_from(lowest)


def parse(html: str) -> Node:
    """Element tree; unclosed and stray tags are mended as far as block structure needs it."""
    root = Node("html")
    tree, at, size, last_end = _Open(root), 0, len(html), html.rfind(">")
    while at < size:
        if at > last_end:  # a tag or comment that begins here has no end
            tree.stack[-1].children.append(_UNENDED.sub("", html[at:]))
            break
        m = _TOKEN.match(html, at)
        at = m.end()
        if (text := m["text"]) is not None:
            tree.stack[-1].children.append(text)
            continue
        name = m["name"] or m["name2"]
        if name is None:
            continue
        tag = name.lower()
        if m["end"] or m["end2"]:
            tree.end(tag)
        elif tag == "body":
            tree.end("head")
            tree.push(Node(tag))
        elif tag != "html":
            tree.make_room(tag)
            tree.push(_named(tag, m["attrs"] or m["attrs2"] or ""), keep_open=tag not in _RAW and tag not in _VOID)
            if tag in _RAW:
                close = _RAW_END[tag].search(html, at)
                at = size if close is None else max(html.find(">", close.start()) + 1, close.start() + 1)
    return root


def _in_order(root: Node) -> list[Node]:
    """All elements, parents first; without recursion, as pages may nest deeply."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(list(node.elements())))
    return order


def _in_article(node: Node) -> bool:
    while (node := node.parent) is not None:
        if node.tag in ("article", "main") and not node.comment:
            return True
    return False


def _prune(root: Node) -> None:
    """Take out side matter.

    An element named so by class or id stays if it holds the main part, an article, or a heading that is an article's
    or comes with at least half of the page's text; one named as comments stays only for the main part or that heading.
    """
    order = _in_order(root)
    for node in reversed(order):
        for child in node.children:
            node.size += len(child) if isinstance(child, str) else child.size
    for node in reversed(order):
        kept = []
        for child in node.children:
            if isinstance(child, Node):
                held = child.main or child.heading and (2 * child.size >= root.size or _in_article(child))
                named = child.comment and not held or child.side and child.tag not in ("body", "main", "article") and not (held or child.article)
                if child.tag in _DROPPED or named:
                    continue
                node.main |= child.main or child.tag == "main"
                node.heading |= child.heading or child.tag == "h1"
                node.article |= child.article or child.tag == "article" and not child.comment
            kept.append(child)
        node.children = kept


def _measure(root: Node) -> list[Node]:
    """Composite density of every node and the sum over its child blocks (its own, if it has none); parents first.

    Phrase elements count as tags but are no blocks to sum: a paragraph that is all bold is one paragraph.
    """
    order = _in_order(root)
    for node in reversed(order):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(child.strip())
            else:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.links += child.links + (child.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        c, t = node.chars, max(node.tags, 1)
        linked, links = max(node.link_chars, 1), max(node.links, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(c / linked * (t / links), 1.0)) / max(math.log(base), 1e-6)
        node.total = sum(x.density for x in node.elements() if x.tag in _BLOCKS) or node.density
    return order


def _content(root: Node) -> set[int]:
    """Identities of the nodes whose whole subtrees are the main text."""
    order = _measure(root)
    best = max((n for n in order if n.tag in _BLOCKS), key=lambda n: n.total)
    if not best.total:
        return {id(root)}
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    for node in path:
        if node.tag in ("article", "main"):
            return {id(node)}
    limit = min((n.density for n in path if n.density), default=0.0)
    top: dict[int, Node] = {}  # the node of the largest sum in each subtree
    for node in reversed(order):
        below = [top[id(c)] for c in node.elements()]
        top[id(node)] = max([node, *below] if node.tag in _BLOCKS or not below else below, key=lambda n: n.total)
    return {id(top[id(n)]) for n in order if n.chars and n.density >= limit}


def main_text(html: str) -> str:
    """Blocks of the main text, one per line; an inline element or line break does not end a block."""
    root = parse(html)
    _prune(root)
    chosen = _content(root)
    blocks: list[str] = []
    pending: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(pending)).split()) if pending else ""
        pending.clear()
        if text:
            blocks.append(text)

    stack: list = [(root, False)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            if inside:
                pending.append(item)
        else:
            inside = inside or id(item) in chosen
            if item.tag == "br":
                pending.append(" ")
            if item.tag in _BLOCKS:
                close()
                stack.append((None, False))
            stack.extend((c, inside) for c in reversed(item.children))
    close()
    return "\n".join(blocks)


_TEXTS = "page_id long, url string, text string, n_chars long"
_TEXTS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        texts = [main_text(h) for h in strings(batch.column(2))]
        yield pa.record_batch([
            batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, type=pa.string()),
            pa.array([len(t) for t in texts], type=pa.int64())], schema=_TEXTS_ARROW)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty page, or one without main text, has the empty text; null ids and urls stay null and repeated
    pages are treated one by one.  Of the whole html nothing is cut off, whatever its length or depth.
    """
    return map_arrow(
        pages, [F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string")],
        _extract, _TEXTS)


@query("op9_html_main_text")
def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))
