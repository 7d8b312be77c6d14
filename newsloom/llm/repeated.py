"""Text that one site repeats in many of its documents, found by content-defined chunking.

A rolling hash over the normalised text cuts it where the hash of the last few characters meets a
condition, so the same passage is cut the same way wherever it stands; line ends always cut,
because the result is told by lines.  Distinct pages are counted per site and chunk, and chunks
that occur on too many are repeated excessively.  A line can only be repeated if all its chunks
are, so these lines alone are counted themselves, exactly, before they are cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.sites import small_side, url_host
from newsloom.llm.textcodes import chunks, joined
from newsloom.session import checkpointed, written

#: A chunk or line is repeated excessively from this many distinct URLs of its site, and this share of them.
MIN_URLS, MIN_SHARE = 3, 0.1
#: Characters that the rolling hash sees, and mean characters between its cuts.
WINDOW, MEAN_CHUNK = 12, 64

_SPACES = re.compile(r"\s+")
_DIGITS = str.maketrans("", "", "0123456789")
_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, np.uint64))


def normal(line: str) -> str:
    """A line without the digits 0-9, without case, each run of white space as one space, none at the ends."""
    return _SPACES.sub(" ", line.translate(_DIGITS)).strip().casefold()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece of an array of code points; ``starts`` begin the pieces."""
    if not len(starts):
        return np.zeros(0, np.int64)
    place = np.arange(len(points)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(points)]])))
    terms = (points.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 0xFFFF] + mixed(place.astype(np.uint64) >> np.uint64(16))
    return mixed(np.add.reduceat(terms, starts)).view(np.int64)


def cut(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each line, hash of each chunk, and the number of the line that each chunk is of."""
    points, offsets = joined(lines, gap=1)
    n = len(points)
    rolling = np.zeros(n, np.uint64)
    codes = points.astype(np.uint64) + np.uint64(1)
    for k in range(WINDOW):
        rolling[k:] += codes[: n - k] * _POWERS[k]
    after = (mixed(rolling) % np.uint64(MEAN_CHUNK)) == 0
    after &= np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets)) >= WINDOW - 1  # the window is within the line
    begins = np.zeros(n, bool)
    begins[1:] = after[:-1]
    begins[offsets[:-1]] = True
    begins[offsets[1:] - 1] = False  # the gap after a line belongs to its last chunk
    empty = np.diff(offsets) == 1
    begins[offsets[:-1][empty]] = True
    starts = np.flatnonzero(begins)
    return hashes(points, offsets[:-1]), hashes(points, starts), np.searchsorted(offsets, starts, "right") - 1


def chunked(articles: DataFrame) -> DataFrame:
    """(article_id, site_key, page, lines array<struct<line_no, key, chunks>>) of every article with content and a host."""
    pages = articles.filter(F.length("content") > 0).select("article_id", url_host(F.col("url")).alias("site_key"), F.xxhash64("url").alias("page"), "content").filter("site_key <> ''")
    kind = articles.schema["article_id"].dataType.simpleString()
    struct = pa.struct([("line_no", pa.int64()), ("key", pa.int64()), ("chunks", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for begin, end in chunks(texts, 400_000):
                split = [t.split("\n") for t in texts[begin:end]]
                numbers, lines, per_row = [], [], []
                for own in split:
                    kept = [(k, n) for k, x in enumerate(own, 1) if (n := normal(x))]
                    numbers.extend(k for k, _ in kept)
                    lines.extend(n for _, n in kept)
                    per_row.append(len(kept))
                keys, chunk_keys, of_line = cut(lines) if lines else (np.zeros(0, np.int64),) * 3
                line_offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
                chunk_offsets = np.searchsorted(of_line, np.arange(len(lines) + 1)).astype(np.int32)
                inner = pa.ListArray.from_arrays(pa.array(chunk_offsets), pa.array(chunk_keys))
                structs = pa.StructArray.from_arrays([pa.array(np.array(numbers, np.int64)), pa.array(keys), inner], fields=list(struct))
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(pa.array(line_offsets), structs)], ["article_id", "site_key", "page", "lines"])

    return pages.mapInArrow(run, f"article_id {kind}, site_key string, page bigint, lines array<struct<line_no:bigint,key:bigint,chunks:array<bigint>>>")


def excessive(occurrences: DataFrame, key: str, totals: DataFrame) -> DataFrame:
    """(site_key, key) that occur on enough distinct pages of their site.

    ``occurrences``: site_key, page, key.  Distinct pages are counted in two steps, each with
    partial aggregation before its shuffle, so no task ever holds the rows of a hot site or chunk.
    """
    counted = occurrences.select("site_key", key, "page").distinct().groupBy("site_key", key).agg(F.count("*").alias("urls"))
    return counted.filter(F.col("urls") >= MIN_URLS).join(totals, "site_key").filter(F.col("urls") >= F.lit(MIN_SHARE) * F.col("all_urls")).select("site_key", key)


def repeated_lines(articles: DataFrame) -> DataFrame:
    """(article_id, line_no, site_key, key) of the lines of ``content`` that a site repeats excessively.

    Null and empty contents, lines that are empty after normalisation and URLs without a host give
    no row; repeated rows of a page count as one page and each give their lines; texts of any
    length are cut whole; an empty table gives an empty result.
    """
    cuts = written(chunked(articles))  # read twice: texts are cut once
    totals = articles.filter(F.length("content") > 0).select(url_host(F.col("url")).alias("site_key"), "url").distinct().groupBy("site_key").agg(F.count("*").alias("all_urls"))
    totals = small_side(totals)
    all_chunks = F.array_distinct(F.flatten(F.transform("lines", lambda x: x["chunks"])))
    repeated = excessive(cuts.select("site_key", "page", F.explode(all_chunks).alias("chunk")), "chunk", totals)
    # At most mean-chunks-per-page / MIN_SHARE chunks a site can be repeated excessively: one bounded row a site.
    by_site = small_side(repeated.groupBy("site_key").agg(F.collect_set("chunk").alias("repeated")))
    candidates = (
        cuts.join(by_site, "site_key")
        .select("article_id", "site_key", "page", F.explode(F.filter("lines", lambda x: F.forall(x["chunks"], lambda c: F.array_contains("repeated", c)))).alias("line"))
        .select("article_id", "site_key", "page", "line.line_no", "line.key")
    )
    candidates = checkpointed(candidates)
    return candidates.join(excessive(candidates, "key", totals), ["site_key", "key"]).select("article_id", "line_no", "site_key", "key")


def without_lines(articles: DataFrame, lines: DataFrame) -> DataFrame:
    """Articles with ``content`` cut by the given (article_id, line_no); lines of one article are gathered, never those of a site."""
    cut_by = lines.groupBy("article_id").agg(F.collect_set("line_no").alias("cut_lines"))
    kept = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains("cut_lines", (i + 1).cast("bigint")))
    return articles.join(cut_by, "article_id", "left").withColumn("content", F.when(F.col("cut_lines").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n"))).drop("cut_lines")
