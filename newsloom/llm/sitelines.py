"""Lines that recur over the pages of a host, counted once over all pages and told again in each text.

Lines are normalised and hashed in Python, batch by batch, in the same pass that needs them anyway;
counting is Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.sites import small_side, url_host

#: A line is boilerplate from this many distinct URLs of its host, and this share of them.
MIN_URLS, MIN_SHARE = 3, 0.1
_DIGITS = re.compile("[0-9]+")


def line_key(line: str) -> int:
    """Signed 64-bit key of a line without the digits 0-9, in lower case, each run of white space as one space, none at the
    ends; 0 if nothing is left."""
    plain = " ".join(_DIGITS.sub("", line).lower().split())
    if not plain:
        return 0
    key = xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass"))
    return key - (1 << 64) if key >= 1 << 63 else key


def page_lines(articles: DataFrame) -> DataFrame:
    """(site_key, page, key): the distinct lines of each page with content."""
    pages = articles.filter(F.length("content") > 0).select(url_host(F.col("url")).alias("site_key"), F.xxhash64("url").alias("page"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{k for line in t.split("\n") if (k := line_key(line))} for t in batch.column(2).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            keys = pa.array([k for f in found for k in f], pa.int64())
            taken = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, keys], ["site_key", "page", "key"])

    return pages.mapInArrow(run, "site_key string, page bigint, key bigint")


def recurrent_lines(articles: DataFrame) -> DataFrame:
    """(site_key, recurrent array<bigint>): keys of the lines that recur over a host's pages.

    Distinct (host, line, URL) are counted in two steps, so a host with a third of all rows is
    pre-aggregated over all tasks.  At most mean-lines-per-page / MIN_SHARE lines a host can pass.
    """
    counted = page_lines(articles).distinct().groupBy("site_key", "key").agg(F.count("*").alias("urls"))
    totals = articles.filter(F.length("content") > 0).select(url_host(F.col("url")).alias("site_key"), F.xxhash64("url").alias("page")).distinct().groupBy("site_key").agg(F.count("*").alias("all_urls"))
    return (
        counted.filter(F.col("urls") >= MIN_URLS)
        .join(totals, "site_key")
        .filter(F.col("urls") >= MIN_SHARE * F.col("all_urls"))
        .groupBy("site_key")
        .agg(F.collect_set("key").alias("recurrent"))
    )


def with_recurrent(keyed: DataFrame, articles: DataFrame) -> DataFrame:
    """``keyed`` (with site_key) with ``recurrent`` of its host; broadcast if such hosts are few: one bounded array a host."""
    return keyed.join(small_side(recurrent_lines(articles)), "site_key", "left")


def host_lines(hosts: pa.Array, recurrent: pa.Array) -> list[frozenset[int]]:
    """The recurrent lines of each row's host, one set a host."""
    known: dict[str | None, frozenset[int]] = {}
    out = []
    for i, host in enumerate(hosts.to_pylist()):
        if host not in known:
            known[host] = frozenset(recurrent[i].as_py() or ())
        out.append(known[host])
    return out


def repeated_flags(lines: list[str], recurrent: frozenset[int]) -> list[bool]:
    """Which lines of a text recur over its host."""
    return [line_key(line) in recurrent for line in lines] if recurrent else [False] * len(lines)
