from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import urls
from newsloom.operators import similarity, zones
from newsloom.operators.clustering import templates_similar
from newsloom.plans import listing
from newsloom.plans.article import ArticleConfig, is_valid, parse_article, parse_articles
from newsloom.plans.collect import collect, list_results
from newsloom.samples import PAIRS, TEMPLATES, URLS
from newsloom.sources import web
from newsloom.sources.dom import content, dom_nodes, parse, path

LIST_PAGE = """<html><body><nav><a href="/">Home</a></nav><div class="news-list"><ul>
<li><a href="/news/2024/12/article1.html">Important thing one!</a><span class="date">2024-12-30 10:00</span></li>
<li><a href="/news/2024/12/article2.html">Important thing two!</a><span class="time">09:30</span></li>
<li><a href="/news/2024/12/article3.html">Important thing 333!</a><span class="time">09:00</span></li></ul></div></body></html>"""
ARTICLE_PAGE = """<html lang="en"><head><title>T - Site</title><meta name="author" content="A. Uthor"><meta name="keywords" content="x, y"></head><body><nav><a href="/">Home</a></nav>
<article><h1>A long headline</h1><p>First paragraph with enough words to count as text.</p><p>Second paragraph, also with <a href="/l">a link</a> in it.<p>Third one is not closed
<table><tr><td>cell one</td><td>cell two</td></tr></table></article><div class="comments"><p>A comment that is long enough to be taken for text by mistake, perhaps.</p></div><footer>Imprint</footer></body></html>"""


def test_demo_list_page():
    assert listing.extract(LIST_PAGE, "https://example.com/news/") == [
        ("Important thing one!", "https://example.com/news/2024/12/article1.html", "2024-12-30 10:00"),
        ("Important thing two!", "https://example.com/news/2024/12/article2.html", "09:30"),
        ("Important thing 333!", "https://example.com/news/2024/12/article3.html", "09:00"),
    ]


@pytest.mark.parametrize("html,base", [(None, "https://a.example/"), ("", "https://a.example/"), ("   ", "https://a.example/"), (LIST_PAGE, ""), (LIST_PAGE, None), ("plain text", "https://a.example/"), ("<a href", "https://a.example/")])
def test_pages_without_items(html, base):
    assert listing.extract(html, base) == []


def test_containers_without_structure_learning():
    found = listing.extract(LIST_PAGE, "https://example.com/news/", listing.ListConfig(learn_structure=False))
    assert [u for _, u, _ in found] == [f"https://example.com/news/2024/12/article{k}.html" for k in (1, 2, 3)]


def test_single_value_rules_equal_column_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS if u], "url string")
    c = urls.url_components(F.col("url"))
    k = urls.classify_url(F.col("url"))
    rows = df.select("url", k["page_type"], k["confidence"], urls.confident_detail(F.col("url")), F.array_join(c["segment_types"], "|"), c["prefix_pattern"], c["extension"]).collect()
    for u, kind, confidence, sure, types, prefix, extension in rows:
        p = listing.parts_of(u)
        assert (listing.page_kind(u), listing.is_sure(u), "|".join(p.kinds), p.prefix, p.extension) == ((kind, confidence), sure, types, prefix, extension), u
    pairs = spark.createDataFrame(PAIRS, "url string, base string").select("url", "base", urls.news_candidate(F.col("url"), F.col("base")), urls.valid_news_url(F.col("url"), F.col("base"))).collect()
    assert all((listing.is_candidate(u, b), listing.is_news_url(u, b)) == (x, y) for u, b, x, y in pairs)
    alike = spark.createDataFrame(TEMPLATES, "a string, b string").select("a", "b", templates_similar(F.col("a"), F.col("b"))).collect()
    assert all(listing.alike(a, b) == s for a, b, s in alike)
    both = df.alias("x").join(df.alias("y"), F.expr("substr(x.url, 1, 12) = substr(y.url, 1, 12)")).select(F.col("x.url").alias("u"), F.col("y.url").alias("v"))
    scored = both.select("u", "v", similarity.similarity(urls.url_components(F.col("u")), urls.url_components(F.col("v")))).collect()
    assert scored and all(abs(listing.likeness(listing.parts_of(u), listing.parts_of(v)) - s) < 1e-9 for u, v, s in scored)


def random_page(rng: random.Random) -> str:
    def box(depth: int) -> str:
        inner = "".join(rng.choice([lambda: box(depth + 1), lambda: f'<a href="/{rng.randrange(9)}">x</a>', lambda: "<p>t</p>"])() for _ in range(rng.randrange(1, 4))) if depth < 5 else ""
        return f"<div>{inner}</div>"

    return f"<html><body>{box(0)}{box(0)}</body></html>"


def naive(nodes, lit):
    """Zones and boundaries by walking the tree."""
    heat = {}
    for n in lit:
        at = n
        while True:
            heat[at.number] = heat.get(at.number, 0) + 1
            if at.parent < 0:
                break
            at = nodes[at.parent]
    zone = {}

    def walk(n):
        hot = [c for c in n.children if heat.get(c.number)]
        if len(hot) == 1:
            walk(hot[0])
        for c in hot if len(hot) > 1 else []:
            inside = [x for x in lit if c.number <= x.number <= c.last]
            for x in inside:
                zone[x.number] = c.number
    walk(nodes[0])
    bound = {}
    for n in lit:
        if n.number not in zone:
            continue
        top, at, steps = n, n, 0
        while at.parent >= 0 and steps < 10:
            at, steps = nodes[at.parent], steps + 1
            if any(x.number != n.number and at.number <= x.number <= at.last and zone.get(x.number) == zone[n.number] for x in lit):
                break
            top = at
        bound[n.number] = top.number
    return heat, zone, bound


def test_zones_equal_a_tree_walk(spark):
    rng = random.Random(5)
    pages = [(k, random_page(rng)) for k in range(40)]
    nodes = dom_nodes(spark.createDataFrame(pages, "page_id bigint, html string"))
    lit = nodes.filter("tag = 'a'").select("page_id", "node", "path")
    heat = {(r.page_id, r.node): r.heat for r in zones.heat_map(lit).collect()}
    zoned = zones.hot_zones(lit)
    zone = {(r.page_id, r.node): r.zone for r in zoned.collect()}
    bound = {(r.page_id, r.node): r.boundary for r in zones.boundaries(zoned).collect()}
    for k, html in pages:
        tree = parse(html)
        links = [n for n in tree if n.tag == "a"]
        h, z, b = naive(tree, links)
        assert {n: v for (p, n), v in heat.items() if p == k} == h
        if len(links) >= 2:
            assert {n: v for (p, n), v in zone.items() if p == k} == z
            assert {n: v for (p, n), v in bound.items() if p == k} == b
            assert {n: x.number for n, x in listing.grown(listing.Page(html, ""), links).items()} == b


def test_lenient_tree():
    tree = parse("<ul><li>one<li>two<script>var x='<p>'</script> tail</ul><p>a<p>b<a href=x>l<a href=y>m</a>")
    assert [n.tag for n in tree] == ["html", "ul", "li", "li", "p", "p", "a", "a"]
    assert content(tree[3]) == "two tail" and path(tree, tree[3]) == [0, 1, 3]


def test_very_deep_and_very_long_pages():
    deep = "<div>" * 5000 + "<p>" + "text " * 30 + "</p>" + "<a href='/news/12345'>A title that is long enough</a>"
    assert max(n.depth for n in parse(deep)) <= 200
    assert parse_article(deep)["success"] and listing.extract(deep, "https://a.example/") in ([], [("A title that is long enough", "https://a.example/news/12345", None)])
    assert len(parse_article("<p>some text here</p>" * 20_000)["content"].split("\n")) == 20_000


def test_article():
    found = parse_article(ARTICLE_PAGE)
    assert found["title"] == "A long headline" and found["author"] == "A. Uthor" and found["tags"] == ["x", "y"] and found["language"] == "en"
    lines = found["content"].split("\n")
    assert lines[:2] == ["First paragraph with enough words to count as text.", "Second paragraph, also with a link in it."] and "comment" not in found["content"]
    assert "cell one | cell two" in found["content"]
    assert "cell one" not in parse_article(ARTICLE_PAGE, ArticleConfig(include_tables=False))["content"]
    assert "[a link](/l)" in parse_article(ARTICLE_PAGE, ArticleConfig(include_links=True))["content"]
    assert parse_article("")["error"] == "empty page" and not parse_article(None)["success"]


def test_collect(spark):
    pages = spark.createDataFrame([(1, "https://example.com/", "https://example.com/", LIST_PAGE), (2, "https://b.example/", "https://b.example/", None)], "page_id bigint, url string, base_url string, html string")
    fetched = spark.createDataFrame([("https://example.com/news/2024/12/article1.html", ARTICLE_PAGE), ("https://example.com/news/2024/12/article2.html", "")], "url string, html string")
    articles, report = collect(pages, fetched, limit=2)
    assert sorted((r.page_id, r.success_count, r.failed_count, r.total_count) for r in report.collect()) == [(1, 1, 1, 3), (2, 0, 0, 0)]
    assert {r.pos: (r.title, r.publish_time) for r in articles.collect()} == {0: ("A long headline", "2024-12-30 10:00"), 1: ("Important thing two!", "09:30")}
    assert collect(pages, fetched, limit=0)[0].count() == 3
    results = {r.page_id: (r.total_count, r.success, r.error) for r in list_results(pages).collect()}
    assert results == {1: (3, True, None), 2: (0, False, "empty page")}


def test_valid_articles(spark):
    df = parse_articles(spark.createDataFrame([("u", ARTICLE_PAGE), ("v", None)], "url string, html string"))
    assert [r[0] for r in df.orderBy("url").select(is_valid(F.col("success"), F.col("content"))).collect()] == [True, False]


def test_fetch_retries():
    import urllib.error

    tries = []

    def failing(url, config):
        tries.append(url)
        raise TimeoutError

    def refused(url, config):
        tries.append(url)
        raise urllib.error.HTTPError(url, 404, "", {}, None)

    config = web.FetchConfig(retries=2, retry_delay=0)
    assert web.attempt("u", config, failing) == (None, None, "timeout") and len(tries) == 3
    assert web.attempt("u", config, refused) == (None, None, "HTTP 404") and len(tries) == 4
    assert web.attempt("u", config, lambda u, c: (b"x", "text/html")) == (b"x", "text/html", None)


def test_stream(spark, tmp_path):
    from newsloom.streaming.items import items_per_hour, new_items

    rows = [(k, LIST_PAGE, "https://example.com/news/", f"2024-12-30 1{k}:00:00") for k in range(2)]
    spark.createDataFrame(rows, "page_id bigint, html string, base_url string, t string").select("page_id", "html", "base_url", F.to_timestamp("t").alias("fetched_at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("page_id bigint, html string, base_url string, fetched_at timestamp").parquet(str(tmp_path / "in"))
    q = new_items(stream).writeStream.format("memory").queryName("new_items").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("new_items").count() == 3
    assert items_per_hour(spark.table("new_items")).count() >= 1
