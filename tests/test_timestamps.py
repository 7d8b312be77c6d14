from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.timestamps.mixture import fit_source, normalize_times, publication_times
from newsloom.timestamps.parse import epoch_seconds, read


def utc(*a) -> int:
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp())


CRAWL = utc(2023, 6, 15, 12, 0)


@pytest.mark.parametrize(
    "text,tz,lang,expected",
    [
        ("2023-06-14T10:00:00Z", "Asia/Tokyo", "ja", utc(2023, 6, 14, 10)),
        ("2023-06-14 10:00", "Asia/Tokyo", "ja", utc(2023, 6, 14, 1)),
        ("20230614T100000Z", "UTC", "en", utc(2023, 6, 14, 10)),
        ("Publié le 20230614T100000Z", "Europe/Paris", "fr", utc(2023, 6, 14, 10)),
        ("2023-06-14T10:00:00.123+0530", "UTC", "en", utc(2023, 6, 14, 4, 30)),
        ("3 hours ago", "UTC", "en", CRAWL - 3 * 3600),
        ("5 Stunden", "UTC", "de", None),
        ("vor 5 Stunden", "UTC", "de", CRAWL - 5 * 3600),
        ("25 de agosto de 2022, 08:58", "Europe/Madrid", "es", utc(2022, 8, 25, 6, 58)),
        ("yesterday, 06:09", "America/New_York", "en", utc(2023, 6, 14, 10, 9)),
        ("12:30", "UTC", "en", utc(2023, 6, 14, 12, 30)),
        ("11:30", "UTC", "en", utc(2023, 6, 15, 11, 30)),
        ("18 เมษายน 2566 22:48 น.", "Asia/Bangkok", "th", utc(2023, 4, 18, 15, 48)),
        ("令和5年6月1日", "Asia/Tokyo", "ja", utc(2023, 5, 31, 15)),
        ("2023年3月29日 下午6:46", "Asia/Shanghai", "zh", utc(2023, 3, 29, 10, 46)),
        ("２０２３/３/２９ ０２：２８", "Asia/Shanghai", "zh", utc(2023, 3, 28, 18, 28)),
        ("2023-06-14 10:00 CST", "Asia/Shanghai", "zh", utc(2023, 6, 14, 2)),
        ("2023-06-14 10:00 CST", "America/Chicago", "en", utc(2023, 6, 14, 16)),
        ("14 tháng 6, 2023 20:53", "Asia/Ho_Chi_Minh", "vi", utc(2023, 6, 14, 13, 53)),
        ("2023-03-26 02:30", "Europe/Berlin", "de", utc(2023, 3, 26, 1, 30)),  # skipped: moved forward
        ("2022-10-30 02:30", "Europe/Berlin", "de", utc(2022, 10, 30, 0, 30)),  # twice: the earlier
        ("2023-02-30 12:00", "UTC", "en", None),
        ("25:71", "UTC", "en", None),
        ("TBA", "UTC", "en", None),
        ("", "UTC", "en", None),
        (None, "UTC", "en", None),
        ("Veröffentlicht am 2023-01-23 12:15:23", "UTC", "de", utc(2023, 1, 23, 12, 15, 23)),
        ("更新于February 23, 2023 9:06 PM CST", "Asia/Shanghai", "zh", utc(2023, 2, 23, 13, 6)),
        ("12:05 AM, 3 June 2023", "UTC", "en", utc(2023, 6, 3, 0, 5)),
        ("just now", "UTC", "en", CRAWL),
        ("1673653057", "UTC", "en", 1673653057),
        ("Dec 24, 10:00 p.m.", "UTC", "en", utc(2022, 12, 24, 22)),
    ],
)
def test_read(text, tz, lang, expected):
    found = read(text, tz, lang, CRAWL)
    assert (None if found is None else found[""]) == expected


def test_orders():
    assert read("05/06/2023", "UTC", "en", CRAWL) == {"dmy": utc(2023, 6, 5), "mdy": utc(2023, 5, 6)}
    assert read("31/05/2023", "UTC", "en", CRAWL) == {"dmy": utc(2023, 5, 31)}


def test_epoch_units():
    assert [epoch_seconds(v) for v in (1673653057, 1673653057123, 1673653057123456789, 0, -1, 2147483647, 253402300799, None)] == [1673653057] * 3 + [None] * 5


def test_mixture_learns_the_order_of_a_source():
    bins = np.array([[1, -1, -1], [1, 2, -1], [-1, 1, -1]])
    assert fit_source(bins, np.array([50.0, 20.0, 0.0]), None).argmax() == 0
    assert fit_source(bins, np.array([0.0, 20.0, 500.0]), None).argmax() == 1
    assert fit_source(np.full((1, 3), -1), np.zeros(1), "mdy").argmax() == 1


SITES = "host string, tz string, lang string, date_order string"
RECORDS = "record_kind string, record_id bigint, url string, stated string, counted bigint, crawl bigint, extra string"


def test_normalize_times_cases(spark):
    sites = spark.createDataFrame([("a.example", "UTC", "en", "mdy"), ("b.example", "UTC", "en", "dmy")], SITES)
    rows = [
        ("item", 1, "https://www.a.example/x", "05/06/2023", None, CRAWL, "x"),
        ("item", 2, "https://b.example/x", "05/06/2023", None, CRAWL, "x"),
        ("item", 3, "https://b.example/x", "not a time", 1673653057000, CRAWL, "x"),
        ("item", 4, "https://b.example/x", None, None, CRAWL, "x"),
        ("item", 5, "https://nowhere.example/x", "2023-06-01", None, CRAWL, None),
        ("item", 6, None, "2023-06-01T00:00:00Z", None, None, None),
        ("item", 7, "https://b.example/x", "x" * 100_000, 5, CRAWL, None),
        ("item", 1, "https://www.a.example/x", "05/06/2023", None, CRAWL, "x"),
    ]
    found = normalize_times(spark.createDataFrame(rows, RECORDS), sites).collect()
    seconds = sorted((r.record_id, r.utc_second) for r in found)
    assert seconds == [(1, utc(2023, 5, 6)), (1, utc(2023, 5, 6)), (2, utc(2023, 6, 5)), (3, 1673653057), (5, utc(2023, 6, 1)), (6, utc(2023, 6, 1))]
    assert {r.record_id: r.ambiguous for r in found}[5]


def test_normalize_times_empty(spark):
    sites = spark.createDataFrame([], SITES)
    assert normalize_times(spark.createDataFrame([], RECORDS), sites).count() == 0


def test_clashing_columns_do_not_matter(spark):
    sites = spark.createDataFrame([("a.example", "UTC", "en", "mdy")], SITES).withColumn("weights", F.lit(1)).withColumn("known", F.lit("x"))
    rows = spark.createDataFrame([("item", 1, "https://a.example/x", "2023-06-01", None, CRAWL, "x")], RECORDS).withColumn("tz", F.lit("?")).withColumn("source_key", F.lit("?"))
    assert normalize_times(rows, sites).count() == 1


def test_orders_are_learned_without_being_known(spark, data):
    """Sites' declared orders against those that their records alone tell."""
    folder = data.replace("sf0.001", "sf0.01")
    items, articles, sites = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("news_items", "articles", "sites"))
    told = publication_times(items, articles, sites).filter("date_order is not null")
    alone = publication_times(items, articles, sites, known_orders=False).filter("date_order is not null")
    both = told.alias("a").join(alone.alias("b"), ["record_kind", "record_id"]).select(F.col("a.utc_second").alias("x"), F.col("b.utc_second").alias("y"), F.col("b.ambiguous").alias("open")).collect()
    wrong = [r for r in both if r.x != r.y]
    assert len(both) > 100 and len(wrong) <= 0.02 * len(both)
    print(len(both), len(wrong), sum(r.open for r in both), sum(r.open for r in wrong))
