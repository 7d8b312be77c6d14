from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsloom import queries
from newsloom.functions.urls import join_url
from newsloom.operators import links

PAGE = """<p><a href="/a">One</a> <A class=x HREF='b?x=1&amp;y=2'>Two <b>bold</b></A><a href=c>Three</a><!-- <a href="/no">no</a> --><script>"<a href='/no'>"</script>
<a href="">empty</a><a href="#top">top</a><a href="javascript:x()">js</a><a href="mailto:x@y">m</a><a name="n">none</a><a href="https://o.example/p">  Four
 lines </a><a href="/a">A longer text</a></p>"""


def test_scan(spark):
    pages = spark.createDataFrame([(1, "https://s.example/d/e", PAGE), (2, "https://s.example/", None), (3, "", "<a href='x'>y</a>"), (4, "https://s.example/", "no links")], "page_id int, base_url string, html string")
    found = links.scan_links(pages)
    assert [(r.page_id, r.url, r.text) for r in found.orderBy("page_id", "pos").collect()] == [
        (1, "https://s.example/a", "One"), (1, "https://s.example/d/b?x=1&y=2", "Two bold"), (1, "https://s.example/d/c", "Three"), (1, "https://o.example/p", "Four lines"), (1, "https://s.example/a", "A longer text"), (3, "x", "y"),
    ]
    best = {(r.page_id, r.url): r.text for r in links.longest_text_link(found).collect()}
    assert best[1, "https://s.example/a"] == "A longer text"
    assert {r.url: r.n_links for r in links.url_map(found).filter("page_id = 1").collect()}["https://s.example/a"] == 2


def test_pages_kept_as_bytes(spark, tmp_path):
    html = '<meta charset="{}"><a href="/a">{}</a><a href="/a">{}, подробно</a>'
    rows = [(1, html.format("utf-8", "Раз", "Два"), None, None), (2, None, html.format("windows-1251", "Новость", "Новость").encode("cp1251"), None), (3, None, "<a href='b'>新闻</a>".encode("gbk"), "text/html; charset=gbk"), (4, None, None, None)]
    pages = spark.createDataFrame([(i, "https://s.example/", "https://s.example/", "t", *r) for i, *r in rows], "page_id int, url string, base_url string, fetched_at string, html string, body binary, content_type string")
    pages.write.parquet(str(tmp_path / "pages_in.parquet"))
    found = {name: queries.queries()[name](spark, str(tmp_path)).collect() for name in ("links_scan_decoded", "url_map_decoded", "longest_link_text_decoded")}
    assert sorted((r.page_id, r.pos, r.text) for r in found["links_scan_decoded"]) == [(1, 0, "Раз"), (1, 1, "Два, подробно"), (2, 0, "Новость"), (2, 1, "Новость, подробно"), (3, 0, "新闻")]
    assert sorted((r.page_id, r.url, r.n_links) for r in found["url_map_decoded"]) == [(1, "https://s.example/a", 2), (2, "https://s.example/a", 2), (3, "https://s.example/b", 1)]
    assert sorted((r.page_id, r.text) for r in found["longest_link_text_decoded"]) == [(1, "Два, подробно"), (2, "Новость, подробно"), (3, "新闻")]


@pytest.mark.parametrize("href", ["", "x", "/x", "//h/x", "?q", "#f", "../x", "../../../x", "./x", "x/./y/../z", "..", ".", "/a/../b/.", "x;p", "https://h/", "mailto:a", "x?y=../z", "g;x=1/../y"])
@pytest.mark.parametrize("base", ["https://s.example/d/e/f?q#g", "https://s.example", "https://s.example/", "http://s.example:8080/d/"])
def test_join_equals_the_standard_library(spark, base, href):
    from urllib.parse import urljoin

    got = spark.createDataFrame([(base, href)], "b string, h string").select(join_url(F.col("b"), F.col("h"))).first()[0]
    expected = urljoin(base, href)
    assert got.rstrip("/") == expected.rstrip("/") if href in ("..", ".", "../../../x") or base == "https://s.example" else got == expected


def test_merge_and_top_k(spark):
    rows = [(1, k % 2, k, f"A title of usual length {k % 5}", f"https://s.example/news/{k % 5}{'/x' * (k % 2)}", None) for k in range(10)]
    items = spark.createDataFrame(rows, "page_id int, container int, pos int, title string, url string, publish_time string")
    merged = links.merge_lists(items)
    assert merged.count() == merged.select("url").distinct().count() == 10
    assert links.top_k(items, ["page_id"], ["pos"], 3).count() == 3 and links.top_k(items, ["page_id"], ["pos"], 0).count() == 10
    assert links.score_items(items.limit(0), ["page_id"]).count() == 0
