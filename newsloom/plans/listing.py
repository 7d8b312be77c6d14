"""News items of list pages.

A page is its own world: nothing of one page bears on another, so the whole extraction of a page
is one step of one task and nothing is shuffled, however many pages there are.  (The same steps
over the node table, as joins and windows, are in ``newsloom.operators``.)  Within a page, link
URLs are judged, story links are lit, the lit links cut the tree into zones, each link is grown to
its boundary, and title and time are looked for inside it.  Where that gives too little, lists of
siblings are scored instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.functions import urls as rules
from newsloom.functions.times import FORMS
from newsloom.sources.dom import Node, content, parse, path


@dataclass(frozen=True)
class ListConfig:
    """Settings of list extraction."""

    min_title_length: int = 8
    min_items_count: int = 3
    use_similarity: bool = True
    similarity_threshold: float = 0.65
    merge_share: float = 0.6
    learn_structure: bool = True


# Class names and patterns by which lists, navigation, items, times and titles are known.
TIME_FORMS = tuple(re.compile(f) for f in FORMS)
TIME_CLASSES = ("time", "date", "publish", "posted", "created", "datetime", "meta")
LIST_CLASS = re.compile(r"(?:news|article|story|post)[_-]?list|list[_-]?(?:content|item)|feed|entry|hot[_-]?box|yaowen|xinwen|liebiao|zixun|dongtai", re.I)
LIST_NAME = re.compile(r"news(?:-l|L|_l)ist|article(?:-l|L|_l)ist|list(?:-c|C|_c)ontent|post(?:-l|L|_l)ist")
NAV_CLASS = re.compile(r"nav|menu|tab|category|channel|section[_-]?link", re.I)
ITEM_CLASS = re.compile(r"(?:post|article|news|story|list)-item")
NOT_NEWS, PAGINATION = re.compile(rules.NOT_NEWS), tuple(re.compile(p) for p in rules.PAGINATION)
NOT_STORIES, ASSETS, STORY_PATHS = re.compile(rules.NOT_STORIES), re.compile(rules.ASSETS), re.compile(rules.STORY_PATHS + r"|/[0-9]{4,}|/[0-9]{4}/[0-9]{1,2}")
NOT_TITLES = re.compile(r"\{\{.*\}\}|\$\{.*\}|<%.*%>|\{%.*%\}|^(?:null|undefined|N/A|loading\.{0,3})$", re.I)
BULLETS, NUMBERING = re.compile(r"^[·•\-*》►▶→]+\s*"), re.compile(r"^[(\[【]?\d{1,3}[)\]】]?[.、)）]?\s*")
TAIL_DATE = re.compile(r"\s+\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?$")
AGE, MARKS = re.compile(r"^\d+\s+(?:hrs?|hours?|mins?|minutes?|days?)\s+(?:ago\s+)?(?=[A-Z])", re.I), re.compile(r"^[\[\]【】()（）·•\-]+\s*")
SERVICES, SECOND, TOP = frozenset(rules.SERVICE_HOSTS), frozenset(rules.SECOND_LEVEL), frozenset([*rules.TOP_LEVEL, *rules.SECOND_LEVEL])
INDEX_WORDS, STORY_WORDS, STATIC_WORDS = frozenset(rules.INDEX_WORDS), frozenset(rules.STORY_WORDS), frozenset(rules.STATIC_WORDS)
STORY_PREFIXES, TOPIC_PREFIXES = frozenset(rules.STORY_PREFIXES), frozenset(rules.TOPIC_PREFIXES)


# --- the column rules once more for a single value; tests hold the two against each other ---


def url_parts(url: str) -> tuple[str, str]:
    """(authority, path without parameters)."""
    try:
        u = urlsplit(url)
    except ValueError:
        return "", ""
    return u.netloc, re.sub(r";[^/]*$", "", u.path)


def registered(domain: str) -> str:
    labels = domain.lower().split(".")
    if len(labels) >= 3 and labels[-2] in SECOND:
        return ".".join(labels[-3:])
    return ".".join(labels[-2:]) if len(labels) >= 2 else domain


def organisation(domain: str) -> str:
    labels = domain.lower().split(".")
    return next((x for x in reversed(labels) if x not in TOP), labels[0])


def is_candidate(url: str, base: str) -> bool:
    if not url or NOT_NEWS.search(url) or any(p.search(url) for p in PAGINATION):
        return False
    if not url.startswith(("http://", "https://")):
        if not base:
            return False
        url = urljoin(base, url)
    a, b = url_parts(url)[0].lower(), url_parts(base)[0].lower()
    if a in SERVICES or registered(a) in SERVICES or not a or not b:
        return False
    return a == b or registered(a) == registered(b) or (organisation(a) != "" and organisation(a) == organisation(b))


def is_news_url(url: str, base: str) -> bool:
    p = url_parts(url)[1].lower()
    return is_candidate(url, base) and not ASSETS.search(p) and not NOT_STORIES.search(p)


def page_kind(url: str) -> tuple[str, float]:
    p = url_parts(url)[1].lower()
    s = [x for x in (p.rsplit(".", 1)[0] if "." in p else p).split("/") if x]
    if not s:
        return "index", 0.8
    last = s[-1]
    for holds, found in (
        (last in INDEX_WORDS, ("index", 0.85)),
        (re.fullmatch(r"\d{5,}", last), ("article", 0.9)),
        (re.search(r"(?:^|/)\d{4}/\d{1,2}/", "/".join(s)), ("article", 0.85)),
        (len(last) > 15 and last.count("-") >= 2, ("article", 0.8)),
        (re.fullmatch(r"[^_]*_\d{5,}", last), ("article", 0.85)),
        (len(s) >= 3 and last not in STORY_WORDS, ("article", 0.6)),
        (STORY_WORDS.intersection(s[:-1]), ("article", 0.7)),
    ):
        if holds:
            return found
    return "unknown", 0.5


def kind_of(s: str, learned: frozenset[str] = frozenset()) -> str:
    if s.isdigit():
        return "number"
    if re.fullmatch(r"\d{4}-\d{2}(?:-\d{2})?", s):
        return "date"
    if s.lower() in STATIC_WORDS or s.lower() in learned:
        return "static"
    if "-" in s and sum(map(str.isalpha, s)) > len(s) / 2 and len(s) > 5:
        return "slug"
    bare = re.sub("[-_]", "", s)
    if re.fullmatch(r"[A-Za-z0-9]{8,}", bare) and re.search(r"\d", s) and re.search("[A-Za-z]", s) and 0.2 <= sum(map(str.isdigit, bare)) / len(bare) <= 0.8:
        return "hash"
    return "static" if s.isalpha() and len(s) < 15 else "mixed"


@dataclass(frozen=True)
class Parts:
    domain: str
    segments: tuple[str, ...]
    kinds: tuple[str, ...]
    extension: str
    prefix: str | None

    @property
    def dated(self) -> bool:
        return "date" in self.kinds

    @property
    def detail(self) -> bool:
        return len(self.segments) >= 2 and (self.dated or self.prefix in STORY_PREFIXES)

    @property
    def topic(self) -> bool:
        return len(self.segments) == 1 and self.prefix in TOPIC_PREFIXES

    @property
    def template(self) -> str:
        return "/".join(s.lower() if k == "static" else f"<{k}>" for s, k in zip(self.segments, self.kinds, strict=True))


def parts_of(url: str, learned: frozenset[str] = frozenset()) -> Parts:
    domain, p = url_parts(url)
    m = re.search(r"\.([^./]*)$", p)
    s = tuple(x for x in (p[: m.start()] if m else p).split("/") if x)
    prefix = next((f[1].lower() for x in s if (f := re.match(r"([A-Za-z]+_)\d", x))), None)
    return Parts(domain, s, tuple(kind_of(x, learned) for x in s), m[1].lower() if m else "", prefix)


def is_sure(url: str) -> bool:
    kind, confidence = page_kind(url)
    if confidence >= 0.7:
        return kind == "article"
    c = parts_of(url)
    if len(c.segments) < 2 or c.prefix in TOPIC_PREFIXES or c.segments[-1].lower() in ("index", "default", "home", "main", "list"):
        return False
    told = any(k == "hash" or (k == "number" and len(s) >= 5) or (k == "mixed" and re.search(r"\d{6}", s)) for s, k in zip(c.segments, c.kinds, strict=True))
    return c.dated or c.prefix in STORY_PREFIXES or told or (len(c.segments) >= 3 and c.kinds[-1] == "slug")


def alike(t1: str, t2: str, threshold: float = 0.7) -> bool:
    a, b = t1.split("/"), t2.split("/")
    if (not a[0].startswith("<") and not b[0].startswith("<") and a[0] != b[0]) or abs(len(a) - len(b)) > 1:
        return False
    points = sum(1.0 if x == y else 0.5 if x.startswith("<") and y.startswith("<") else 0.0 for x, y in zip(a, b, strict=False))
    return points / min(len(a), len(b)) >= threshold


def main_structure(found: list[str]) -> list[str]:
    if len(found) < 3:
        return found
    clusters: dict[tuple, list[str]] = {}
    for u in found:
        c = parts_of(u)
        clusters.setdefault((c.template, len(c.segments), c.dated), []).append(u)
    most = max(map(len, clusters.values()))
    if most < 2:
        return found
    least = max(3, int(most * 0.1))
    accepted = {f for f, us in clusters.items() if len(us) >= least and any(map(is_sure, us))}
    follows = {f for f, us in clusters.items() if len(us) < least and any(alike(f[0], g[0]) for g in accepted)}
    kept = {u for f in accepted | follows for u in clusters[f]}
    return [u for u in found if u in kept]


def anchors_of(found: list[str]) -> list[str]:
    sure = [u for u in found if is_sure(u)]
    if len(sure) < 2:
        return main_structure(found)
    clustered = main_structure(sure)
    return clustered if len(clustered) >= 2 else sure


def likeness(a: Parts, b: Parts) -> float:
    root = lambda d: d.split(".")[-2:] if d.count(".") else [d]
    if root(a.domain) != root(b.domain) or abs(len(a.segments) - len(b.segments)) > 1 or (a.detail and b.topic) or (a.topic and b.detail):
        return 0.0
    if a.prefix and b.prefix and a.prefix != b.prefix:
        return 0.0
    if not a.kinds and not b.kinds:
        structure = 1.0
    elif not a.kinds or not b.kinds:
        structure = 0.0
    else:
        points, met = 0.0, False
        for s, t, k, m in zip(a.segments, b.segments, a.kinds, b.kinds, strict=False):
            if k == m == "static":
                same = s.lower() == t.lower()
                if not same and not met:
                    points = 0.0
                    break
                met, points = True, points + same
            elif k == m:
                points += 1.0
            elif {k, m} == {"slug", "mixed"}:
                points += 0.5
            elif {k, m} == {"number", "mixed"}:
                points += 0.3
        structure = points / max(len(a.kinds), len(b.kinds))
    if a.extension != b.extension:
        structure *= 0.8
    x, y = ({s.lower() for s, k in zip(c.segments, c.kinds, strict=True) if k == "static"} for c in (a, b))
    if x or y:
        overlap = len(x & y) / len(x | y)
    elif a.prefix and b.prefix:
        overlap = 1.0
    else:
        overlap = 0.8 if a.dated and b.dated else 0.5
    return 0.8 * structure + 0.2 * overlap


def similar_to(samples: list[str], others: list[str], threshold: float) -> list[str]:
    counts: dict[str, int] = {}
    for u in samples:
        for s in url_parts(u)[1].split("/"):
            if s:
                counts[s] = counts.get(s, 0) + 1
    learned = frozenset(s for s, n in counts.items() if n >= 2)
    known = list({(p.template, p.domain, p.extension, p.prefix): p for p in (parts_of(u, learned) for u in samples)}.values())
    return [u for u in others if any(likeness(k, c) >= threshold for c in [parts_of(u, learned)] for k in known)]


def link_text(text: str) -> str:
    return TAIL_DATE.sub("", NUMBERING.sub("", BULLETS.sub("", " ".join(text.split())))).strip()


def plain_text(text: str) -> str:
    return TAIL_DATE.sub("", AGE.sub("", NUMBERING.sub("", BULLETS.sub("", " ".join(text.split()))))).strip()


def bare_title(text: str) -> str:
    return MARKS.sub("", " ".join(text.split())).strip()


def time_in(text: str | None) -> str | None:
    for form in TIME_FORMS:
        if text and (m := form.search(text)):
            return m[1].strip()
    return None


def short_time(text: str | None) -> str | None:
    t = (text or "").strip()
    return time_in(t) if 5 < len(t) < 25 and re.search(r"\d", t) and re.search("[-/:年月日]", t) else None


# --- one page ---


class Page:
    """A parsed page with what extraction asks of it."""

    def __init__(self, html: str, base: str):
        self.nodes, self.base = parse(html), base
        self._text: dict[int, str] = {}
        self.anchors = [n for n in self.nodes if n.tag == "a" and "href" in n.attrs]

    def text(self, n: Node) -> str:
        if n.number not in self._text:
            self._text[n.number] = content(n)
        return self._text[n.number]

    def inside(self, n: Node) -> list[Node]:
        return self.nodes[n.number + 1 : n.last + 1]

    def up(self, n: Node) -> Iterator[Node]:
        while n.parent >= 0:
            n = self.nodes[n.parent]
            yield n

    def url(self, a: Node) -> str:
        href = a.attrs.get("href", "")
        return href if href.startswith(("http://", "https://")) or not self.base else urljoin(self.base, href)

    def siblings(self, n: Node) -> list[Node]:
        return self.nodes[n.parent].children if n.parent >= 0 else [n]

    def first(self, n: Node, test: Callable[[Node], bool]) -> Node | None:
        return next((d for d in self.inside(n) if test(d)), None)

    # times

    def stated(self, n: Node) -> str | None:
        """What a time element states."""
        return (n.attrs.get("datetime") or "").strip() or self.text(n).strip() or None

    def classed(self, n: Node, within: Callable[[Node], bool] = lambda d: True) -> str | None:
        for word in TIME_CLASSES:
            for d in self.inside(n):
                if word in d.attrs.get("class", "") and within(d) and (t := time_in(self.text(d))):
                    return t
        return None

    def spans(self, n: Node) -> str | None:
        return next((t for d in self.inside(n) if d.tag == "span" and (t := short_time(self.text(d)))), None)

    def in_link(self, a: Node) -> str | None:
        return self.spans(a) or next((t for x in (a.text, *(c.tail for c in a.children)) if (t := short_time(x))), None)

    def of_sibling(self, n: Node) -> str | None:
        if n.tag == "a":
            return None
        if n.tag == "time" and (t := self.stated(n)):
            return t
        if any(w in n.attrs.get("class", "").lower() for w in TIME_CLASSES) and (t := time_in(self.text(n))):
            return t
        return short_time(self.text(n)) if n.tag in ("span", "em", "i", "small", "time", "div", "p") else None

    def beside(self, a: Node, within: Callable[[Node], bool] = lambda d: True) -> str | None:
        around = self.siblings(a)
        order = [*around[a.place + 1 : a.place + 3], *reversed(around[max(0, a.place - 2) : a.place])]
        return next((t for n in order if within(n) and (t := self.of_sibling(n))), None) or short_time(a.tail)

    def of_node(self, n: Node) -> str | None:
        """A time in a node, else in up to two levels around it that hold few links."""
        if (e := self.first(n, lambda d: d.tag == "time")) and (t := self.stated(e)):
            return t
        if t := self.classed(n) or self.spans(n):
            return t
        loose, linked = [], []
        for d in [n, *self.inside(n)]:
            in_link = d.tag == "a" or any(p.tag == "a" for p in self.up(d) if p.number >= n.number)
            (linked if in_link else loose).append(d.text)
            if d is not n:
                (linked if any(p.tag == "a" for p in self.up(d) if p.number >= n.number) else loose).append(d.tail)
        if t := time_in(" ".join(x.strip() for x in loose if x.strip())):
            return t
        if t := next((t for x in linked if (t := short_time(x))), None):
            return t
        for level, p in enumerate(self.up(n)):
            if level == 2 or sum(d.tag == "a" and "href" in d.attrs for d in self.inside(p)) > 3:
                return None
            if (e := self.first(p, lambda d: d.tag == "time")) and (t := self.stated(e)):
                return t
            if t := self.classed(p):
                return t
        return None

    def in_boundary(self, a: Node, b: Node, lit: set[int]) -> str | None:
        """A time of a lit link, from within its boundary only."""
        held = lambda d: b.number <= d.number <= b.last
        if t := self.in_link(a) or self.beside(a, held):
            return t
        if (e := self.first(b, lambda d: d.tag == "time")) and (t := self.stated(e)):
            return t
        if t := self.classed(b) or self.spans(b):
            return t
        texts = [x.strip() for d in [b, *self.inside(b)] if d.tag != "a" and d.number not in lit for x in (d.text, d.tail) if x.strip()]
        return time_in(" ".join(texts))

    # titles

    def container(self, a: Node) -> Node | None:
        """The nearest list entry or box around a link that has a like sibling."""
        for level, p in enumerate(self.up(a)):
            if level == 5:
                return None
            if p.tag in ("li", "article", "section", "div") and p.parent >= 0 and sum(s.tag == p.tag for s in self.siblings(p)) >= 2:
                return p
        return None

    def title_of(self, a: Node) -> tuple[str | None, int]:
        """(title, score) of a link: headings in it, its title attribute, its text, headings around it.  The scores are fixed values."""
        for tag, score in (("h1", 100), ("h2", 90), ("h3", 80), ("h4", 70)):
            if (h := self.first(a, lambda d, tag=tag: d.tag == tag)) and len(t := plain_text(self.text(h))) >= 4:
                return t, score
        if len(given := a.attrs.get("title", "")) >= 4:
            return plain_text(given), 60
        if len(t := plain_text(self.text(a))) >= 4:
            return t, 55
        if box := self.container(a):
            for tag, score in (("h2", 85), ("h3", 75), ("h4", 65)):
                for c in box.children:
                    for h in [c] if c.tag == tag else [x for x in c.children if x.tag == tag][:1]:
                        if len(t := plain_text(self.text(h))) >= 4:
                            return t, score
        for level, p in enumerate(self.up(a), 1):
            named = p.attrs.get("class", "").lower()
            if level > 3 or p.tag in ("article", "section", "main", "body", "ul", "ol", "li") or any(w in named for w in ("list", "news", "items", "feed", "wrap", "container")):
                break
            if sum(d.tag == "a" for d in self.inside(p)) > 3:
                break
            for tag, score in (("h2", 82), ("h3", 72), ("h4", 62)):
                for c in p.children:
                    if c.tag == tag and len(t := plain_text(self.text(c))) >= 4:
                        return t, max(score - 3 * level, 35)
        return None, 0

    def boundary_title(self, a: Node, b: Node) -> str:
        own = self.text(a).strip()
        if len(own) >= 15:
            return bare_title(own)
        tests = [lambda d, h=h: d.tag == h for h in ("h1", "h2", "h3", "h4")] + [lambda d, w=w: w in d.attrs.get("class", "") for w in ("title", "headline")]
        for test in tests:
            for d in self.inside(b):
                if test(d) and len(t := self.text(d).strip()) >= 10:
                    return bare_title(t)
        return bare_title(own)

    def boundary_time(self, b: Node) -> str | None:
        if (e := self.first(b, lambda d: d.tag == "time" and "datetime" in d.attrs)) and e.attrs["datetime"]:
            return e.attrs["datetime"]
        for word in ("time", "date", "publish"):
            for d in self.inside(b):
                if word in d.attrs.get("class", "") and 0 < len(t := self.text(d).strip()) < 50:
                    return t
        return None


def grown(page: Page, lit: list[Node]) -> dict[int, Node]:
    """Boundary of each lit link, in closed form: zones are the children of the lowest common ancestor."""
    paths = {n.number: path(page.nodes, n) for n in lit}
    if len(lit) < 2:
        return {n.number: page.nodes[paths[n.number][max(0, len(paths[n.number]) - 4)]] for n in lit}
    ordered = sorted(lit, key=lambda n: n.number)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    shared = common(paths[ordered[0].number], paths[ordered[-1].number])
    zone = {n.number: paths[n.number][min(shared, len(paths[n.number]) - 1)] for n in ordered}
    out = {}
    for k, n in enumerate(ordered):
        p = paths[n.number]
        near = [ordered[j] for j in (k - 1, k + 1) if 0 <= j < len(ordered) and zone[ordered[j].number] == zone[n.number]]
        stop = max((common(p, paths[m.number]) for m in near), default=0)
        out[n.number] = page.nodes[p[max(min(stop, len(p) - 1), len(p) - 11, 0)]]
    return out


Item = tuple[str, str, str | None]  # title, url, publish_time


def by_zones(page: Page, config: ListConfig) -> list[Item]:
    found: list[tuple[str, Node]] = []
    for a in page.anchors:
        href = a.attrs["href"]
        if href and not href.startswith(("javascript:", "#", "mailto:", "tel:", "data:")) and is_candidate(u := page.url(a), page.base):
            found.append((u, a))
    if len(found) < 3:
        return []
    of_url: dict[str, Node] = {}
    for u, a in found:
        if u not in of_url or (len(t := page.text(a).strip()) > len(page.text(of_url[u]).strip()) and len(t) >= 5):
            of_url[u] = a
    everything = list(of_url)
    sure = anchors_of(everything)
    if len(sure) < 2:
        return []
    matched = set(sure)
    if config.use_similarity:
        matched.update(similar_to(sure, [u for u in everything if u not in matched], config.similarity_threshold))
    lit = [of_url[u] for u in everything if u in matched]
    boundary = grown(page, lit)
    # times look at every link of a matched URL, titles at one a URL
    lit_all = [a for u, a in ((page.url(a), a) for a in page.anchors) if u in matched]
    wide, numbers = grown(page, lit_all), {a.number for a in lit_all}
    links_of: dict[str, list[Node]] = {}
    for a in lit_all:
        links_of.setdefault(page.url(a), []).append(a)
    items = []
    for u in sorted(matched, key=lambda u: of_url[u].number):
        a = of_url[u]
        b = boundary[a.number]
        title, time = page.boundary_title(a, b), None
        best, best_score = None, 0
        for x in links_of.get(u, []):
            t, score = page.title_of(x)
            when = page.in_boundary(x, wide[x.number], numbers)
            if score > best_score:
                best, best_score, time = t, score, when
            elif score == best_score and when and not time:
                time = when
        if best and len(best) >= config.min_title_length and len(best) > len(title):
            title = bare_title(best)
        time = time or page.boundary_time(b)
        if len(title) >= config.min_title_length:
            items.append((title, u, time))
    return items


def containers(page: Page) -> list[Node]:
    """Places where lists are likely, the most telling first, each once."""
    count = lambda n, tag: sum(c.tag == tag for c in n.children)
    in_main = lambda n: any(p.tag == "main" for p in page.up(n))
    named = lambda n: f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"
    tests = [
        lambda n: in_main(n) and (n.tag in ("ul", "ol") or (n.tag == "div" and "list" in n.attrs.get("class", ""))),
        lambda n: count(n, "article") > 0,
        lambda n: bool(LIST_NAME.search(named(n))),
        lambda n: n.tag == "ul" and count(n, "li") >= 3,
        lambda n: n.tag == "div" and (count(n, "div") >= 3 or count(n, "article") >= 3),
        lambda n: n.tag in ("div", "ul", "section", "article") and bool(LIST_CLASS.search(named(n))),
    ]
    return list({n.number: n for test in tests for n in page.nodes if test(n)}.values())


def is_navigation(page: Page, n: Node) -> bool:
    if n.tag in ("nav", "header", "footer") or n.attrs.get("role") in ("navigation", "menu", "menubar"):
        return True
    if NAV_CLASS.search(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"):
        lengths = [len(page.text(d).strip()) for d in page.inside(n) if d.tag == "a"]
        return bool(lengths) and sum(lengths) / len(lengths) < 10
    return False


def of_container(page: Page, box: Node, config: ListConfig) -> list[Item]:
    items = []
    for entry in box.children:
        if entry.tag not in ("li", "div", "article", "section", "a"):
            continue
        title, link = None, None
        heading = next((h for tag in ("h1", "h2", "h3", "h4") if (h := page.first(entry, lambda d, tag=tag: d.tag == tag))), None)
        if heading is not None:
            link = page.first(heading, lambda d: d.tag == "a")
            title = page.text(link or heading).strip()
            if link is None and page.nodes[heading.parent].tag == "a":
                link = page.nodes[heading.parent]
        if link is None:
            best = max((d for d in page.inside(entry) if d.tag == "a"), key=lambda d: len(link_text(page.text(d))), default=None)
            if best is not None and (t := link_text(page.text(best))):
                title = t
                link = best if len(t) >= config.min_title_length else None
        if link is None or not title or len(title) < config.min_title_length:
            continue
        if is_news_url(u := page.url(link), page.base):
            items.append((title, u, page.of_node(entry)))
    return items


def score(items: list[Item]) -> float:
    """Points of a list of items; fixed values."""
    n = len(items)
    lengths = [len(t) for t, _, _ in items]
    mean = sum(lengths) / n
    paths = [url_parts(u)[1] for _, u, _ in items]
    total = min(n, 20) * 1.5 + (20 if 15 <= mean <= 50 else 10 if mean > 50 else 0) + 30 * sum(bool(w) for _, _, w in items) / n
    total += 20 if len({p.count("/") for p in paths}) == 1 else 0
    total -= 100 if sum(len([s for s in p.split("/") if s]) <= 1 for p in paths) / n > 0.5 else 0
    return max(0.0, total - (30 if sum(k < 10 for k in lengths) > 0.3 * n else 0))


def everywhere(page: Page, config: ListConfig) -> list[Item]:
    """Any link that looks like news: those with headings first, then by their classes, then the rest."""
    area = next((n for n in page.nodes if n.tag in ("main", "article") or n.attrs.get("role") == "main"), page.nodes[0])
    anchors = [d for d in page.inside(area) if d.tag == "a" and "href" in d.attrs]
    telling = re.compile("[Tt]itle|[Hh]eadline")
    ranks = (
        lambda a: any(d.tag in ("h2", "h3") for d in page.inside(a)),
        lambda a: any(telling.search(d.attrs.get("class", "")) for d in page.inside(a)),
        lambda a: bool(ITEM_CLASS.search(a.attrs.get("class", ""))),
        lambda a: True,
    )
    items: dict[str, Item] = {}
    for a in {a.number: a for rank in ranks for a in anchors if rank(a)}.values():
        around = []
        for p in page.up(a):
            if len(around) == 5 or p.tag in ("body", "html"):
                break
            around.append(p)
        if any(p.tag in ("nav", "header", "footer") or NAV_CLASS.search(f"{p.attrs.get('class', '')} {p.attrs.get('id', '')}") for p in around):
            continue
        least = config.min_title_length
        heading = next((h for tag in ("h2", "h3", "h4", "h1") if (h := page.first(a, lambda d, tag=tag: d.tag == tag))), None)
        title = page.text(heading).strip() if heading else ""
        if len(title) < least:
            title = next((t for d in [a, *page.inside(a)] if telling.search(d.attrs.get("class", "").lower()) and len(t := page.text(d).strip()) >= least), title)
        if len(title) < least:
            title = link_text(page.text(a))
        u = page.url(a)
        if len(title) >= least and is_news_url(u, page.base) and u not in items:
            items[u] = (title, u, page.of_node(a))
    return list(items.values())


def validated(items: list[Item], config: ListConfig) -> list[Item]:
    out: dict[str, Item] = {}
    for t, u, w in items:
        bare = t.strip()
        if u not in out and len(bare) >= config.min_title_length and not NOT_TITLES.search(bare) and not any(p.search(u) for p in PAGINATION):
            out[u] = (t, u, w)
    if len(out) >= 5:
        kept = set(main_structure(list(out)))
        return [i for u, i in out.items() if u in kept]
    return list(out.values())


def extract(html: str | None, base: str | None, config: ListConfig = ListConfig()) -> list[Item]:
    """Items of one list page, in document order."""
    page = Page(html or "", base or "")
    if not page.nodes:
        return []
    if config.learn_structure and len(items := by_zones(page, config)) >= 3:
        return validated(items, config)
    lists, small = [], []
    for box in containers(page):
        if is_navigation(page, box):
            continue
        items = of_container(page, box, config)
        if len(items) >= config.min_items_count:
            lists.append((score(items), items))
        else:
            small.extend(i for i in items if len(i[0]) >= 15 and len([s for s in url_parts(i[1])[1].split("/") if s]) >= 2 and STORY_PATHS.search(url_parts(i[1])[1].lower()))
    if not lists and (items := everywhere(page, config)):
        lists.append((score(items), items))
    if not lists:
        return []
    lists.sort(key=lambda x: -x[0])
    best = lists[0][0]
    merged = [i for s, items in lists if s >= best * config.merge_share for i in items]
    return validated([*merged, *(small if merged else [])], config)


def list_items(pages: DataFrame, html: str = "html", base: str = "base_url", config: ListConfig = ListConfig()) -> DataFrame:
    """(page_id, pos, title, url, publish_time) of the news items of each list page.

    Pages that are null, blank or without news links, and pages without a base URL, give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "pos", "title", "url", "publish_time"]
        for batch in batches:
            rows = []
            for page, text, base_url in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows.extend((page, k, *item) for k, item in enumerate(extract(text, base_url, config)))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            kinds = [batch.schema.types[0], pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", html, base).mapInArrow(run, f"page_id {kind}, pos int, title string, url string, publish_time string")
