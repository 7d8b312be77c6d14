from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsloom.functions import encoding, times


def test_decode_falls_back():
    assert encoding.decode_bytes("中文新闻".encode("gbk"), "utf-8") == ("中文新闻", "gbk")
    assert encoding.decode_bytes("é".encode(), None)[0] == "é"
    assert encoding.decode_bytes(b"\xff\x81", "ascii-x")[1] in ("gbk", "gb18030", "latin-1")
    assert encoding.decode_bytes(None, None) == (None, None)


@pytest.mark.parametrize(
    "head,expected",
    [
        (b"\xef\xbb\xbf<html>", "utf-8"), (b"\xff\xfe<", "utf-16-le"), (b"\xfe\xff<", "utf-16-be"), (b"\x00\x00\xfe\xff", "utf-32-be"),
        (b'<meta charset="GB2312">', "gbk"), (b'<meta http-equiv="Content-Type" content="text/html; charset=latin1">', "latin-1"),
        (b'<meta content="text/html; charset=big5" http-equiv=Content-Type>', "big5"), (b'<?xml version="1.0" encoding="koi8-r"?>', "koi8-r"), (b"<html>", None), (b"", None),
    ],
)
def test_declared_charset(spark, head, expected):
    df = spark.createDataFrame([(bytearray(head),)], "body binary")
    assert df.select(encoding.charset_of_html(F.col("body"))).collect()[0][0] == expected


def test_pages(spark):
    rows = [(1, None, bytearray("<p>新闻</p>".encode("gbk")), "text/html; charset=gb2312"), (2, "ok", None, None), (3, "cafÃ©", None, "text/html; charset=utf-8"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "page_id int, html string, body binary, content_type string")
    found = {r[0]: r[1] for r in df.select("page_id", encoding.decoded_page(F.col("html"), F.col("body"), F.col("content_type"))["text"]).collect()}
    assert found == {1: "<p>新闻</p>", 2: "ok", 3: "café", 4: None}


def test_relative_times(spark):
    df = spark.createDataFrame([("3 小时前",), ("5 minutes ago",), ("刚刚",), ("2024-12-30 10:00",), ("zzz",), (None,)], "t string")
    assert [r[0] for r in df.select(times.to_epoch(F.col("t"), F.lit(1_000_000))).collect()] == [1_000_000 - 10800, 1_000_000 - 300, 1_000_000, 1735524000, None, None]
