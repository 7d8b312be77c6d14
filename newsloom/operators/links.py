"""Links of pages, scanned without leaving the JVM, and relational operators over them."""

from __future__ import annotations

import html.entities
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.titles import collapsed
from newsloom.functions.urls import join_url

#: Parts of a page whose links do not count.
NO_CONTENT = r"(?is)<!--.*?-->|<(script|style|noscript|iframe)\b.*?</\1\s*>"
ANCHOR = r"""(?is)<a\s[^>]*?\bhref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)[^>]*>.*?(?=</a\s*>|<a\s|$)"""
HREF = r"""(?is)^<a\s[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
SKIPPED = r"^(?:javascript:|#|mailto:|tel:|data:)"
#: Characters of the named entities of HTML 4; the ampersand comes last, on its own.
ENTITIES = {f"&{name};": chr(code) for name, code in html.entities.name2codepoint.items() if name != "amp"} | {"&apos;": "'"}


def _replaced(text: Column, form: str, character: Callable[[Column], Column]) -> Column:
    """Text with each distinct match of ``form`` replaced by its character; without one it stays."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(form), 0))
    return F.aggregate(found, text, lambda acc, e: F.coalesce(F.replace(acc, e, character(e)), acc))


def unescaped(text: Column) -> Column:
    """Text with its entities as characters: named ones, and numbers up to the last of Unicode."""

    def numbered(form: str, base: int) -> Callable[[Column], Column]:
        def character(e: Column) -> Column:
            code = F.conv(F.regexp_extract(e, form, 1), base, 10).cast("bigint")
            known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
            return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

        return character

    known = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    plain = _replaced(text, "&[A-Za-z][A-Za-z0-9]*;", lambda e: F.try_element_at(known, e))
    for form, base in (("&#([0-9]{1,7});", 10), ("&#[xX]([0-9A-Fa-f]{1,6});", 16)):
        plain = _replaced(plain, form, numbered(form, base))
    return F.when(text.contains("&"), F.replace(plain, F.lit("&amp;"), F.lit("&"))).otherwise(text)


def scan_links(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """(page_id, base_url, pos, href, url, text) of every ``<a href>`` in document order, absolute, special schemes left out.

    Null pages and pages without links give no row.
    """
    found = F.posexplode(F.regexp_extract_all(F.regexp_replace(F.col(html_column), NO_CONTENT, ""), F.lit(ANCHOR), 0)).alias("pos", "anchor")
    href = F.concat(*(F.regexp_extract("anchor", HREF, k) for k in (1, 2, 3)))
    links = pages.select("page_id", "base_url", found).select(
        "page_id", "base_url", "pos", unescaped(href).alias("href"), collapsed(unescaped(F.regexp_replace(F.regexp_replace("anchor", r"(?s)^<a\s[^>]*>", ""), r"(?s)<[^>]*>", ""))).alias("text")
    )
    return links.filter((F.col("href") != "") & ~F.col("href").rlike(SKIPPED)).select(
        "page_id", "base_url", "pos", "href", F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(join_url(F.col("base_url"), F.col("href"))).alias("url"), "text"
    )


def keep_first(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rank = 1").drop("_rank")


def url_map(links: DataFrame) -> DataFrame:
    """(page_id, url, n_links, first_pos): how often and where a URL is linked first."""
    return links.groupBy("page_id", "url").agg(F.count("*").alias("n_links"), F.min("pos").alias("first_pos"))


def longest_text_link(links: DataFrame, least: int = 5) -> DataFrame:
    """One link a URL: the first one, unless a later text is longer and has ``least`` characters; of equal ones the first."""
    by_length = Window.partitionBy("page_id", "url").orderBy(F.when(F.length("text") >= least, F.length("text")).otherwise(0).desc(), "pos")
    first = F.first(F.struct("pos", "text")).over(Window.partitionBy("page_id", "url").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = links.withColumn("_rank", F.row_number().over(by_length)).withColumn("_first", first)
    longer = (F.length("text") > F.length("_first.text")) & (F.length("text") >= least)
    return ranked.filter("_rank = 1").select(
        "page_id", "url", F.when(longer, F.col("pos")).otherwise(F.col("_first.pos")).alias("pos"), F.when(longer, F.col("text")).otherwise(F.col("_first.text")).alias("text")
    )


def ranked(rows: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """Rows with ``rank``, their place from 1 within each key in the given order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each key; all of them for k of 0 or less."""
    if k <= 0:
        return rows
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def neighbour_value(value: str, by: list[str], order: list[str], reach: int = 2) -> Column:
    """The nearest value among the following rows, else among the preceding ones, within ``reach``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return F.coalesce(*(F.lead(value, k).over(w) for k in range(1, reach + 1)), *(F.lag(value, k).over(w) for k in range(1, reach + 1)))


def score_items(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_items, score): how much a list of items looks like news.

    Points for the number of items, titles of a usual length, times and paths of one depth; minus
    points for many short paths or titles; never below 0.
    """
    from newsloom.functions.urls import path, segments

    depth = F.size(F.split(path(F.col("url")), "/"))
    length = F.length("title")
    agg = items.groupBy(*by).agg(
        F.count("*").alias("n_items"),
        F.avg(length).alias("mean"),
        F.count_if(F.coalesce(F.col("publish_time"), F.lit("")) != "").alias("timed"),
        F.count_distinct(depth).alias("depths"),
        F.count_if(F.size(segments(path(F.col("url")))) <= 1).alias("shallow"),
        F.count_if(length < 10).alias("short"),
    )
    n = F.col("n_items")
    score = (
        F.least(n, F.lit(20)) * 1.5
        + F.when(F.col("mean").between(15, 50), 20).when(F.col("mean") > 50, 10).otherwise(0)
        + F.col("timed") / n * 30
        + F.when(F.col("depths") == 1, 20).otherwise(0)
        - F.when(F.col("shallow") / n > 0.5, 100).otherwise(0)
        - F.when(F.col("short") > n * 0.3, 30).otherwise(0)
    )
    return agg.select(*by, "n_items", F.greatest(score, F.lit(0.0)).alias("score"))


def merge_lists(items: DataFrame, page: str = "page_id", container: str = "container", share: float = 0.6, ties: tuple[str, ...] = ()) -> DataFrame:
    """Items of the containers that score at least ``share`` of their page's best, each URL once: best container, then position
    first, then the columns ``ties``."""
    scored = items.join(score_items(items, [page, container]), [page, container])
    best = F.max("score").over(Window.partitionBy(page))
    kept = scored.withColumn("_best", best).filter(F.col("score") >= F.col("_best") * share).withColumn("_low", -F.col("score")).drop("_best")
    return keep_first(kept, [page, "url"], ["_low", container, "pos", *ties]).drop("_low")
