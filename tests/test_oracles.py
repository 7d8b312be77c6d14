"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from newsloom import queries
from newsloom.functions import encoding, urls

#: What tells the rows of each query without SQL apart.
KEYS = {
    "links_scan_decoded": ["page_id", "pos"], "url_map_decoded": ["page_id", "url"], "longest_link_text_decoded": ["page_id", "url"], "decoded_pages": ["page_id"], "dom_nodes": ["page_id", "node"],
    "heat_map": ["page_id", "node"], "hot_zones": ["page_id", "node"], "boundaries": ["page_id", "node"], "list_items": ["page_id", "pos"], "page_results": ["page_id"], "article_extract": ["article_id"], "articles_as_json": ["article_id"],
    "collect_report": ["page_id"], "collected_articles": ["page_id", "pos"], "p1_found": ["record_kind", "record_id"],
}


def rows(frame) -> list[tuple]:
    columns = sorted(frame.columns)

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "∅"
        return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in frame.select(columns).collect()), key=str)


def sql_rows(result, description) -> list[tuple]:
    names = [d[0] for d in description]
    order = sorted(range(len(names)), key=names.__getitem__)

    def plain(v):
        if v is None:
            return "∅"
        return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(r[k]) for k in order) for r in result), key=str)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, duck, name):
    found = queries.queries()[name](spark, data)
    cursor = duck.execute(queries.oracle_sql()[name])
    description = cursor.description
    expected = cursor.fetchall()
    assert sorted(found.columns) == sorted(d[0] for d in description)
    assert rows(found) == sql_rows(expected, description)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_gives_rows(spark, data, name):
    found = queries.queries()[name](spark, data)
    key = KEYS[name]
    assert found.count() == found.select(*key).distinct().count() > 0 and found.filter(" or ".join(f"{k} is null" for k in key)).count() == 0


def test_scan_of_all_pages_holds_that_of_texts(spark, data):
    text, everything = (queries.queries()[n](spark, data) for n in ("links_scan", "links_scan_decoded"))
    pages = spark.read.parquet(f"{data}/pages_in.parquet")
    clean = text.join(pages.filter("html is not null").filter(~encoding.looks_misread(F.col("html"))).select("page_id"), "page_id")
    assert clean.exceptAll(everything).count() == 0 and everything.exceptAll(text).count() > 0


def test_zones_hold_the_lit_links(spark, data):
    heat, zoned, bounds = (queries.queries()[n](spark, data) for n in ("heat_map", "hot_zones", "boundaries"))
    hottest = {r.page_id: r.heat for r in heat.groupBy("page_id").agg(F.max("heat").alias("heat")).collect()}
    links = {r.page_id: r.n for r in zoned.groupBy("page_id").agg(F.count("*").alias("n")).collect()}
    assert links and all(hottest[p] == n for p, n in links.items())
    sizes = zoned.groupBy("page_id", "zone").agg(F.count("*").alias("n"), F.max("zone_size").alias("size")).filter("n <> size").count()
    assert sizes == 0 and bounds.count() == zoned.count()


def test_items_are_news_of_their_page(spark, data):
    items = queries.queries()["list_items"](spark, data)
    pages = spark.read.parquet(f"{data}/pages_in.parquet").select("page_id", "base_url")
    assert items.join(pages, "page_id").filter(~urls.news_candidate(F.col("url"), F.col("base_url"))).count() == 0
    assert items.filter(F.length(F.trim("title")) < 8).count() == 0
    assert items.filter(F.lower("publish_time").rlike("ago$|前$|yesterday|昨天") & F.col("timestamp").isNull()).count() == 0
