from __future__ import annotations

import urllib.error

from pyspark.sql import Observation
from pyspark.sql import functions as F

from newsloom.functions.times import to_epoch
from newsloom.operators.links import ranked, scan_links, unescaped
from newsloom.plans.collect import collect, timed_items
from newsloom.plans.facade import collect_news, news_articles, news_lists
from newsloom.samples import FETCHED, LISTS, STORIES
from newsloom.sources.web import FetchConfig

PAGES = {u: h for _, u, h in LISTS if h} | dict(STORIES)
QUICK = FetchConfig(delay=(0, 0), retry_delay=0, retries=1, tasks=2)


def opener(pages: dict[str, str]):
    def get(url, config):
        if url not in pages:
            raise urllib.error.HTTPError(url, 404, "Not Found", None, None)
        return pages[url].encode("utf-8"), "text/html; charset=utf-8"

    return get


def test_lists_from_urls(spark):
    urls = spark.createDataFrame([(u, "x") for _, u, _ in LISTS] + [(None, "x"), (LISTS[0][1], "x")], "url string, error string")
    found = {r.url: r for r in news_lists(urls, fetching=QUICK, opener=opener(PAGES)).collect()}
    assert {u: (r.total_count, r.success, r.error) for u, r in found.items()} == {LISTS[0][1]: (5, True, None), LISTS[1][1]: (0, True, None), LISTS[2][1]: (0, False, "HTTP 404")}
    assert [i.title for i in found[LISTS[0][1]]["items"]][0].startswith("Ferry operator &")


def test_articles_from_urls(spark):
    urls = spark.createDataFrame([(u,) for u, _ in STORIES] + [("https://kel.example/gone",)], "url string")
    found = {r.url: r for r in news_articles(urls, fetching=QUICK, opener=opener(PAGES)).collect()}
    assert found[STORIES[0][0]].success and found[STORIES[0][0]].title == "Footbridge opens" and found[STORIES[0][0]].crawled_at.endswith("Z")
    assert not found["https://kel.example/gone"].success and found["https://kel.example/gone"].error == "HTTP 404"
    assert news_articles(urls.limit(0), fetching=QUICK, opener=opener(PAGES)).count() == 0


def test_collect_from_urls(spark):
    urls = spark.createDataFrame([(u,) for _, u, _ in LISTS], "url string")
    for limit, n in ((50, 5), (2, 2), (0, 5)):
        articles, report = collect_news(urls, limit, fetching=QUICK, opener=opener(PAGES))
        assert articles.count() == n and all(r.crawled_at for r in articles.collect())
        assert sorted((r.success_count, r.failed_count, r.total_count) for r in report.collect()) == [(0, 0, 0), (0, 0, 0), (min(n // 5, 1), n - n // 5, 5)]


def test_observation_counts_articles(spark):
    pages = spark.createDataFrame([(k, u, u, h) for k, u, h in LISTS], "page_id bigint, url string, base_url string, html string")
    stories = spark.createDataFrame([(u, h, "2024-01-02T04:30:00+00:00") for u, h in STORIES], "url string, html string, crawled_at string")
    seen = Observation("collected")
    articles, _ = collect(pages, stories, observation=seen)
    rows = {r.url: r for r in articles.collect()}
    assert seen.get == {"articles": 5, "succeeded": 1, "failed": 4} and rows[STORIES[0][0]].crawled_at == "2024-01-02T04:30:00+00:00"


def test_times_without_a_reference_stay_open(spark):
    pages = spark.createDataFrame([(k, u, h) for k, u, h in LISTS], "page_id bigint, base_url string, html string")
    found = {r.publish_time: r.timestamp for r in timed_items(pages).collect()}
    assert found["2 hours ago"] is None and found["2024-01-01"] == 1704038400


def test_relative_forms(spark):
    expected = {
        "3 months ago": FETCHED - 92 * 86400, "2 weeks ago": FETCHED - 14 * 86400, "3 小時 前": FETCHED - 3 * 3600, "昨天": FETCHED - 86400, "Yesterday": FETCHED - 86400, "前天": FETCHED - 172800, "today": FETCHED, "刚刚": FETCHED,
        "1月1日": 1704038400, "1-1": 1704038400, "10:30": 1704162600, "31-31": None, "13月1日": None, "25:00": None, "": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in expected], "t string")
    assert {r.t: r.e for r in df.select("t", to_epoch(F.col("t"), F.lit(FETCHED)).alias("e")).collect()} == expected


def test_entities(spark):
    texts = {"a &amp; b": "a & b", "&#x27;q&#39; &#38;amp;": "'q' &", "&eacute;t&eacute; &hellip;": "été …", "&#128512;&#99999999;&#0;&unknown;": "😀&#99999999;&#0;&unknown;", "&amp;lt;": "&lt;", "&": "&", "": "", None: None}
    texts["&#x27;q&#39; &#38;amp;"] = "'q' &"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.u for r in df.select("t", unescaped(F.col("t")).alias("u")).collect()} == texts
    page = spark.createDataFrame([(1, "https://a.example/", '<a href="/x?a=1&#38;b=2">Caf&eacute; &#x2014; news</a>')], "page_id bigint, base_url string, html string")
    assert [(r.href, r.text) for r in scan_links(page).collect()] == [("/x?a=1&b=2", "Café — news")]


def test_ranks(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 5), (2, "c", 1)], "g int, x string, n int")
    assert sorted((r.g, r.x, r["rank"]) for r in ranked(df, ["g"], [F.desc("n")]).collect()) == [(1, "a", 2), (1, "b", 1), (2, "c", 1)]
