"""The main body of a page: which lines of the extracted content are the article's own text.

The standard library's parser streams the page as events; block ends and line breaks cut it into
lines.  The text-to-tag ratio of the lines is smoothed with a Gaussian and clustered by a threshold
into content and the rest; the element that holds most of the content lines is the content region.
Within it, lines that are mostly links, lines in boxes of their own, and lines that the site
repeats on many pages or that carry the site's name (bylines, notices) are not the article's own.
The lines of ``content`` are matched with those of the page in order; what the page lacks (it may
be cut off) is judged by its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.sitelines import host_lines, repeated_flags, with_recurrent
from newsloom.llm.sites import with_site

#: Width of the Gaussian in lines, and the share of a line's characters in links that makes it navigation.
SIGMA, LINKED = 1.5, 0.5

BLOCKS = frozenset("html body p div section article main header footer nav aside ul ol li dl dt dd table tbody thead tr td th h1 h2 h3 h4 h5 h6 blockquote figure figcaption form fieldset pre hr br button center address details summary".split())
CONTAINERS = frozenset("body div section article main header footer nav aside table tr td th form fieldset details figure center".split())
SKIPPED = frozenset("script style noscript template iframe head svg".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_KERNEL = np.exp(-0.5 * (np.arange(-4, 5) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()
_SPACES = re.compile(r"\s+")


class Lines(HTMLParser):
    """Cuts a stream of parser events into lines: (text, tags, characters in links, tag, containers, marked)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, str, tuple[int, ...], bool]] = []
        self.stack: list[tuple[str, int, bool]] = []  # tag, number if it is a container, has attributes
        self.count = 0
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.skipping = 0

    def _end_line(self) -> None:
        if self.text:
            text = _SPACES.sub(" ", "".join(self.text)).strip()
            if text:
                containers = tuple(n for _, n, _ in self.stack if n)
                block = next(((t, m) for t, _, m in reversed(self.stack) if t in BLOCKS), ("", False))
                self.lines.append((text, self.tags, self.linked, block[0], containers, block[1]))
                self.tags = 0
            self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skipping += 1
            return
        self.tags += 1
        if tag == "a":
            self.links += 1
        if tag in BLOCKS:
            self._end_line()
            if tag in ("p", "li", "tr", "td", "dt", "dd") or tag in HEADINGS:
                self._close(tag, ("p", tag) if tag != "p" else ("p",))
        if tag not in VOID:
            number = 0
            if tag in CONTAINERS:
                self.count += 1
                number = self.count
            self.stack.append((tag, number, any(k in ("class", "id", "style") for k, _ in attrs)))

    def _close(self, tag: str, kinds: tuple[str, ...]) -> None:
        """A paragraph, entry, cell or heading that is still open ends where the next one begins."""
        for k in range(len(self.stack) - 1, -1, -1):
            t = self.stack[k][0]
            if t in kinds:
                del self.stack[k:]
                return
            if t in CONTAINERS or t in ("ul", "ol", "table"):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
            return
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS:
            self._end_line()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        self.text.append(data)
        if self.links:
            self.linked += len(data)

    def finish(self) -> list[tuple[str, int, int, str, tuple[int, ...], bool]]:
        try:
            self.close()
        except AssertionError:
            pass
        self._end_line()
        return self.lines


def page_lines(html: str) -> list[tuple[str, int, int, str, tuple[int, ...], bool]]:
    parser = Lines()
    try:
        parser.feed(html)
    except AssertionError:  # malformed declarations
        pass
    return parser.finish()


def content_mask(lines: list[tuple]) -> np.ndarray:
    """Which lines are content: the smoothed text-to-tag ratios above the threshold between two clusters."""
    ratio = np.array([len(x[0]) / (1 + x[1]) for x in lines])
    smooth = np.log1p(np.convolve(np.pad(ratio, 4, mode="edge"), _KERNEL, mode="valid"))
    low, high = smooth.min(), smooth.max()
    for _ in range(20):
        cut = (low + high) / 2
        a, b = smooth[smooth <= cut], smooth[smooth > cut]
        if not len(b):
            break
        new = a.mean(), b.mean()
        if abs(new[0] - low) + abs(new[1] - high) < 1e-6:
            break
        low, high = new
    return smooth > (low + high) / 2 if high > low else np.ones(len(lines), bool)


def own_lines(lines: list[tuple]) -> np.ndarray:
    """Which lines of the page are in the content region and not navigation within it."""
    n = len(lines)
    if not n:
        return np.zeros(0, bool)
    mask = content_mask(lines)
    linked = np.array([x[2] >= LINKED * len(x[0]) for x in lines])
    weight: dict[int, int] = {}
    total = 0
    for x, m, l in zip(lines, mask.tolist(), linked.tolist(), strict=True):
        if m and not l and x[3] != "h1":
            total += len(x[0])
            for c in x[4]:
                weight[c] = weight.get(c, 0) + len(x[0])
    depth = {c: k for x in lines for k, c in enumerate(x[4])}
    main = max((c for c, w in weight.items() if w >= 0.6 * total), key=lambda c: (depth[c], weight[c]), default=0)
    # boxes inside the region: containers below it; a box is the article's own if it is mostly running text
    box_text: dict[int, list[int]] = {}
    for x, l in zip(lines, linked.tolist(), strict=True):
        if main in x[4] and x[4][-1] != main:
            t = box_text.setdefault(x[4][x[4].index(main) + 1], [0, 0, 0])
            t[0] += len(x[0])
            t[1] += len(x[0]) if l else 0
            t[2] += 1
    out = np.zeros(n, bool)
    for k, x in enumerate(lines):
        paragraph = x[3] == "p" and x[4][-1:] == (main,)  # scripts without spaces: a linked first word can be most of it
        if main and main not in x[4] or linked[k] and not paragraph or x[3] == "h1" or x[3] == "button":
            continue
        if x[4] and x[4][-1] != main and main in x[4]:
            size, links, _ = box_text[x[4][x[4].index(main) + 1]]
            if links >= LINKED * size or size < 0.08 * total:
                continue
        if x[3] in HEADINGS and k + 1 < n and linked[k + 1] and x[4] == lines[k + 1][4]:
            continue
        out[k] = True
    return out


def key(text: str) -> str:
    return _SPACES.sub("", text).casefold()


def line_flags(content: str, html: str, repeated: list[bool], source: str | None) -> list[bool]:
    """For each line of ``content``: is it the article's own text?"""
    lines = page_lines(html)
    own = own_lines(lines)
    name = key(source) if source else ""
    places: dict[str, list[int]] = {}
    for k, x in enumerate(lines):
        places.setdefault(key(x[0]), []).append(k)
    texts = content.split("\n")
    matched: list[int] = []
    last = -1
    for t in texts:
        at = places.get(key(t))
        k = -1
        if at:
            k = next((p for p in at if p > last), at[-1])
            last = k
        matched.append(k)
    # between matched neighbours, as many unmatched lines on either side are the same lines
    i = 0
    while i < len(texts):
        if matched[i] >= 0 or not texts[i].strip():
            i += 1
            continue
        j = i
        while j < len(texts) and matched[j] < 0:
            j += 1
        before = matched[i - 1] if i else -1
        after = matched[j] if j < len(texts) else len(lines)
        gap = [k for k in range(before + 1, after) if lines[k][3] != "h1"] if after > before else []
        if len(gap) == j - i:
            matched[i:j] = gap
        i = j
    region = np.flatnonzero(own)
    end = int(region[-1]) if len(region) else -1
    flags, previous, ended = [], False, False
    for t, k, r in zip(texts, matched, repeated, strict=True):
        bare = t.strip()
        if not bare:
            flags.append(True)
            continue
        marked = r or (bool(name) and name in key(bare) and len(bare) < 200)
        if k >= 0:
            flag = bool(own[k])
            ended |= k > end and end >= 0
        else:
            # the page lacks this line: running text goes on unless the region has ended
            prose = bool(re.search(r"[.!?…。！？।][\"'”’“»」』）)]*$", bare)) or len(bare) >= 60
            flag = not ended and (previous or prose) and " > " not in bare and " | " not in bare
        previous = flag if not marked else previous
        flags.append(flag and not marked)
    return flags


def prepared(articles: DataFrame, sites: DataFrame) -> DataFrame:
    """(article_id, content, raw_html, site_key, recurrent, site_source, site_lang) of articles with content."""
    with_content = articles.filter(F.length("content") > 0).select("article_id", "url", "content", "raw_html")
    known = with_recurrent(with_site(with_content, sites, ("source", "lang")), articles)
    return known.select("article_id", "content", "raw_html", "site_key", "recurrent", "site_source", "site_lang")


def foreign_lines(articles: DataFrame, sites: DataFrame) -> DataFrame:
    """(article_id, line_no) of the lines of ``content`` that are not the article's own text, in articles with ``raw_html``.

    Articles without content or without raw_html (null or empty) give no row; blank lines give no
    row; a page that is cut off or broken is used as far as it goes; texts of any length are read
    whole; repeated rows give repeated rows; an empty table gives an empty result.
    """
    kind = articles.schema["article_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers = [], []
            columns = [batch.column("content").to_pylist(), batch.column("raw_html").to_pylist(), host_lines(batch.column("site_key"), batch.column("recurrent")), batch.column("site_source").to_pylist()]
            for i, (content, html, recurrent, source) in enumerate(zip(*columns, strict=True)):
                flags = line_flags(content, html, repeated_flags(content.split("\n"), recurrent), source)
                found = [k for k, f in enumerate(flags, 1) if not f]
                rows.extend([i] * len(found))
                numbers.extend(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int64())], ["article_id", "line_no"])

    ready = prepared(articles, sites).filter(F.length("raw_html") > 0)
    return ready.select("article_id", "content", "raw_html", "site_key", "recurrent", "site_source").mapInArrow(run, f"article_id {kind}, line_no bigint")
