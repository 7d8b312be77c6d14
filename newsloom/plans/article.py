"""Article pages: title, text and metadata of each, one page a row, nothing shuffled.

This is an extractor of its own: it keeps the element whose paragraphs hold most unlinked text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.sources.dom import Node, content, parse

FURNITURE = frozenset("nav header footer aside form button select".split())
UNLIKELY = re.compile(r"comment|sidebar|share|related|promo|cookie|banner|footer|header|\bnav\b|menu|breadcrumb|newsletter", re.I)
COMMENTS = re.compile(r"comment|disqus|replies", re.I)
LINES = frozenset("p h2 h3 h4 li blockquote pre figcaption dd dt".split())
_SPACES = re.compile(r"\s+")
SCHEMA = (
    "title string, content string, author string, publish_time string, source string, description string, categories array<string>, "
    "tags array<string>, language string, success boolean, error string"
)
# Names of page metadata by what they hold, in the order of precedence.
META = {
    "title": ("og:title", "twitter:title", "dc.title"),
    "author": ("author", "article:author", "dc.creator", "byl"),
    "publish_time": ("article:published_time", "pubdate", "publishdate", "date", "dc.date", "og:published_time"),
    "source": ("og:site_name", "source", "application-name"),
    "description": ("description", "og:description", "twitter:description"),
    "categories": ("article:section", "section", "category"),
    "tags": ("keywords", "news_keywords", "article:tag"),
}


@dataclass(frozen=True)
class ArticleConfig:
    """What the text includes."""

    include_comments: bool = False
    include_tables: bool = True
    include_links: bool = False
    include_images: bool = False


def squeezed(text: str) -> str:
    return _SPACES.sub(" ", text).strip()


def metadata(nodes: list[Node]) -> dict[str, str]:
    found: dict[str, str] = {}
    for n in nodes:
        if n.tag == "meta" and (value := n.attrs.get("content", "").strip()):
            name = (n.attrs.get("property") or n.attrs.get("name") or n.attrs.get("itemprop") or "").lower()
            found.setdefault(name, value)
    return {k: next((found[n] for n in names if n in found), "") for k, names in META.items()}


def _linked(n: Node) -> int:
    return len(content(n)) if n.tag == "a" else sum(_linked(c) for c in n.children)


def body(nodes: list[Node], config: ArticleConfig) -> str:
    """Text of the element whose paragraphs hold most unlinked text, one line a paragraph."""
    barred: set[int] = set()
    for n in nodes:
        named = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"
        comments = bool(COMMENTS.search(named))
        out = n.tag in FURNITURE or (not config.include_tables and n.tag == "table") or (comments and not config.include_comments) or (not comments and n.tag not in ("html", "body", "main", "article") and bool(UNLIKELY.search(named)))
        if n.parent in barred or out:
            barred.add(n.number)
    weight: dict[int, float] = {}
    loose = lambda n: len(squeezed(n.text + " ".join(c.tail for c in n.children)))
    for n in nodes:
        if n.number in barred:
            continue
        if n.tag in ("p", "blockquote", "pre"):
            size = len(squeezed(content(n))) - _linked(n)
        elif n.tag in ("div", "td", "section", "article", "font"):
            size = loose(n)
        else:
            continue
        at, share = n.parent if n.tag in ("p", "blockquote", "pre") else n.number, 1.0
        while at >= 0 and share > 0.2:
            weight[at] = weight.get(at, 0.0) + max(size, 0) * share
            at, share = nodes[at].parent, share * 0.5
    if not weight:
        return ""
    best = nodes[max(weight, key=lambda k: (weight[k], k))]
    lines: list[str] = []

    def add(text: str) -> None:
        if t := squeezed(text):
            lines.append(t)

    def told(n: Node) -> str:
        out = [n.text]
        for c in n.children:
            if c.tag == "img":
                out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})" if config.include_images else "")
            elif c.tag == "a" and config.include_links and "href" in c.attrs:
                out.append(f"[{squeezed(content(c))}]({c.attrs['href']})")
            else:
                out.append(told(c))
            out.append(c.tail)
        return "".join(out)

    def walk(n: Node) -> None:
        if n.number in barred:
            return
        if n.tag in LINES:
            if len(t := squeezed(content(n))) and _linked(n) < 0.8 * len(t):
                add(told(n))
            return
        if n.tag == "tr":
            add(" | ".join(squeezed(told(c)) for c in n.children))
            return
        run = n.text
        for c in n.children:
            if c.tag in LINES or c.tag in ("div", "table", "tbody", "tr", "ul", "ol", "section", "article", "br", "figure", "td", "h1", *FURNITURE) or c.number in barred:
                add(run)
                run = ""
                if c.tag != "h1":
                    walk(c)
            else:
                run += told(c) if not (c.tag == "a" and config.include_links) else f"[{squeezed(content(c))}]({c.attrs.get('href', '')})"
            run += c.tail
        add(run)

    walk(best)
    return "\n".join(lines)


def parse_article(html: str | None, config: ArticleConfig = ArticleConfig()) -> dict:
    """Fields of one article page; an empty page or one without text is a failure with its reason."""
    nodes = parse(html)
    empty = dict.fromkeys(("title", "content", "author", "publish_time", "source", "description", "language")) | {"categories": [], "tags": [], "success": False}
    if not nodes:
        return empty | {"error": "empty page"}
    meta = metadata(nodes)
    text = body(nodes, config)
    first = lambda tag: next((squeezed(content(n)) for n in nodes if n.tag == tag and content(n).strip()), "")
    title = first("h1") or meta["title"] or re.sub(r"\s+[-|–]\s+[^-|–]*$", "", first("title"))
    when = meta["publish_time"] or next((n.attrs.get("datetime") or squeezed(content(n)) for n in nodes if n.tag == "time"), "")
    author = meta["author"] or next((squeezed(content(n)) for n in nodes if re.search(r"author|byline", n.attrs.get("class", ""), re.I) and content(n).strip()), "")
    several = lambda s: [x.strip() for x in re.split(r"[,;，、]", s) if x.strip()]
    lang = next((n.attrs.get("lang") for n in nodes if n.tag == "html"), None)
    return empty | {
        "title": title or None, "content": text or None, "author": author or None, "publish_time": when or None, "source": meta["source"] or None, "description": meta["description"] or None,
        "categories": several(meta["categories"]), "tags": several(meta["tags"]), "language": lang or None, "success": bool(text), "error": None if text else "no text found",
    }


def parse_articles(pages: DataFrame, keys: tuple[str, ...] = ("url",), html: str = "html", config: ArticleConfig = ArticleConfig()) -> DataFrame:
    """``keys`` and the fields of each article page.  Null and blank pages give a failure row, not none."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string()] * 6 + [pa.list_(pa.string())] * 2 + [pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_article(t, config) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array([f[n] for f in found], k) for n, k in zip(names, kinds, strict=True))], [*keys, *names])

    head = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, html).mapInArrow(run, f"{head}, {SCHEMA}")


def is_valid(success: Column, text: Column) -> Column:
    """Fetched, with more than 50 characters of text."""
    return F.coalesce(success & (F.length(text) > 50), F.lit(False))
