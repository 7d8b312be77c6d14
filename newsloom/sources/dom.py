"""Pages as trees: a lenient tokeniser over the standard library's parser, and the node table.

``dom_nodes`` shreds pages into one row an element, numbered in document order, with the path of
numbers from the root.  Ancestors are the prefix of a node's path and its subtree is the range
``node .. last``, so tree questions become joins and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose subtree does not count; text after them stays.
DROPPED = frozenset("script style noscript iframe template".split())
#: An open element of the first kind ends where one of the second begins, up to its list or table.
ENDS = {"li": ("li",), "p": ("p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "li", "header", "footer", "nav", "main", "aside", "blockquote", "form"), "a": ("a",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
SCOPES = frozenset("ul ol table div section article main body html nav header footer aside select dl".split())
#: Depth below which elements are kept as siblings.
#: Elements nested deeper than this become siblings of the last one that deep; their links, texts and order stay.
MAX_DEPTH = 200
_SPACES = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    number: int
    parent: int
    depth: int
    place: int  # among its siblings
    tag: str
    attrs: dict
    text: str = ""  # before the first child
    tail: str = ""  # after the element
    children: list = field(default_factory=list)
    last: int = 0  # last number of the subtree


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.open: list[Node] = []
        self.dropping = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED:
            self.dropping += 1
            return
        if self.dropping:
            return
        for k in range(len(self.open) - 1, -1, -1):
            t = self.open[k].tag
            if tag in ENDS.get(t, ()):
                del self.open[k:]
                break
            if t in SCOPES:
                break
        if not self.nodes and tag != "html":  # a fragment gets a root
            self.nodes.append(Node(0, -1, 1, 0, "html", {}))
            self.open.append(self.nodes[0])
        parent = self.open[-1] if self.open else None
        if parent is None and self.nodes:
            parent = self.nodes[0]  # one root: what follows it belongs to it
        known = {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        node = Node(len(self.nodes), parent.number if parent else -1, parent.depth + 1 if parent else 1, len(parent.children) if parent else 0, tag, known)
        self.nodes.append(node)
        if parent:
            parent.children.append(node)
        if tag not in VOID and node.depth < MAX_DEPTH:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropping = max(0, self.dropping - 1)
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.dropping or not self.nodes:
            return
        at = self.open[-1] if self.open else self.nodes[0]
        if at.children:
            at.children[-1].tail += data
        else:
            at.text += data


def parse(html: str | None) -> list[Node]:
    """Nodes of a page in document order; none for an empty page."""
    if not html or not html.strip():
        return []
    builder = TreeBuilder()
    try:
        builder.feed(html)
        builder.close()
    except AssertionError:  # malformed declarations end the page
        pass
    for node in reversed(builder.nodes):
        node.last = max([node.number, *(c.last for c in node.children[-1:])])
    return builder.nodes


def content(node: Node) -> str:
    """Text of the subtree, without the tail."""
    out = [node.text]
    for child in node.children:
        out.append(content(child))
        out.append(child.tail)
    return "".join(out)


def path(nodes: list[Node], node: Node) -> list[int]:
    out = []
    at = node
    while True:
        out.append(at.number)
        if at.parent < 0:
            return out[::-1]
        at = nodes[at.parent]


NODES = "node int, parent int, depth int, place int, last int, tag string, class string, id string, role string, href string, title_attr string, datetime string, text string, tail string, path array<int>"


def dom_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, node, parent, depth, place, last, tag, class, id, role, href, title_attr, datetime, text, tail, path).

    The one crossing into Python; null and blank pages give no row.
    """
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, {NODES}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [None, *[pa.int32()] * 5, *[pa.string()] * 9, pa.list_(pa.int32())]
        for batch in batches:
            for begin in range(0, max(batch.num_rows, 1), 200):
                part = batch.slice(begin, 200)
                rows: list[tuple] = []
                for page, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    nodes = parse(text)
                    for n in nodes:
                        a = n.attrs
                        rows.append((page, n.number, n.parent, n.depth, n.place, n.last, n.tag, a.get("class"), a.get("id"), a.get("role"), a.get("href"), a.get("title"), a.get("datetime"), n.text, n.tail, path(nodes, n)))
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k or batch.schema.types[0]) for c, k in zip(columns, kinds, strict=True)], names)

    return pages.select("page_id", html).mapInArrow(run, schema)
