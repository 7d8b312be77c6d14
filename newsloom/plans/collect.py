"""Collecting: list pages to items, items to articles, and a report for each list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from newsloom.functions.times import to_epoch
from newsloom.operators.links import keep_first, top_k
from newsloom.plans.article import ArticleConfig, parse_articles
from newsloom.plans.listing import ListConfig, list_items
from newsloom.timestamps.mixture import utc_second


def with_timestamps(items: DataFrame, reference_ts: str | None = None) -> DataFrame:
    """Items with ``timestamp``, the UTC second of their time, relative ones against the column ``reference_ts``."""
    return items.withColumn("timestamp", to_epoch(F.col("publish_time"), F.col(reference_ts) if reference_ts else None))


def timed_items(pages: DataFrame, config: ListConfig = ListConfig()) -> DataFrame:
    """``list_items`` with timestamps; relative times count from ``fetched_at`` of their page where ``pages`` has it."""
    items = list_items(pages, config=config)
    if "fetched_at" not in pages.columns:
        return with_timestamps(items)
    fetched = pages.select("page_id", utc_second("fetched_at", pages.schema["fetched_at"].dataType.simpleString()).alias("_fetched")).dropDuplicates(["page_id"])
    return with_timestamps(items.join(fetched, "page_id", "left"), "_fetched").drop("_fetched")


def page_counts(pages: DataFrame, items: DataFrame) -> DataFrame:
    """(page_id, url, total_count, success) of each page; a page without items is a failure."""
    counts = items.groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.join(counts, "page_id", "left").select("page_id", "url", F.coalesce("n", F.lit(0)).alias("total_count"), F.col("n").isNotNull().alias("success"))


def list_results(pages: DataFrame, config: ListConfig = ListConfig()) -> DataFrame:
    """(page_id, url, items, total_count, success, error) of each list page; a page without text is a failure."""
    items = timed_items(pages, config)
    # items of one page: bounded by the links of the page
    gathered = items.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "title", "url", "publish_time", "timestamp"))).alias("items"))
    shaped = F.transform(F.coalesce("items", F.array()), lambda i: F.struct(i["title"].alias("title"), i["url"].alias("url"), i["publish_time"].alias("publish_time"), i["timestamp"].alias("timestamp")))
    joined = pages.select("page_id", "url", (F.length(F.trim("html")) > 0).alias("has_text")).join(gathered, "page_id", "left")
    ok = F.coalesce("has_text", F.lit(False))
    return joined.select("page_id", "url", shaped.alias("items"), F.size(shaped).alias("total_count"), ok.alias("success"), F.when(~ok, "empty page").alias("error"))


def has_text(success: Column, content: Column) -> Column:
    return F.coalesce(success & (F.coalesce(content, F.lit("")) != ""), F.lit(False))


def success_counts(articles: DataFrame, by: str) -> DataFrame:
    """(by, success_count, failed_count): articles with text, and others."""
    good = has_text(F.col("success"), F.col("content"))
    return articles.groupBy(by).agg(F.count_if(good).alias("success_count"), F.count_if(~good).alias("failed_count"))


def with_articles(items: DataFrame, articles: DataFrame, order: list[str]) -> DataFrame:
    """Items with the fields of the article of their URL (the first one in ``order``); title and time are the article's, else the
    item's; ``fetched``: there is an article with text."""
    crawled = keep_first(articles, ["url"], order).withColumnsRenamed({"title": "_title", "publish_time": "_time"})
    joined = items.join(crawled, "url", "left")
    own = lambda a, i: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(i))
    return joined.withColumns({"title": own("_title", "title"), "publish_time": own("_time", "publish_time"), "fetched": has_text(F.col("success"), F.col("content"))}).drop("_title", "_time")


def collect(pages: DataFrame, article_pages: DataFrame, limit: int = 50, config: ListConfig = ListConfig(), article_config: ArticleConfig = ArticleConfig(), observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, report).

    ``article_pages``: url, html of fetched article pages, with ``crawled_at`` where that is known.  Articles: one row
    for each of the first ``limit`` items of a list (all for 0 or less), with the item's title and time where the article
    has none, the time of the crawl (else that of the run) in ISO 8601, and a failure where the page was not fetched.
    Report: (page_id, success_count, failed_count, total_count).  ``observation`` gets ``articles``, ``succeeded`` and
    ``failed`` as the articles are computed.
    """
    items = list_items(pages, config=config)
    wanted = top_k(items, ["page_id"], ["pos"], limit)
    first = keep_first(article_pages.select("url", "html", *(["crawled_at"] if "crawled_at" in article_pages.columns else [])), ["url"], ["html"])
    parsed = parse_articles(first, config=article_config)
    joined = with_articles(wanted, parsed, ["url"])
    crawled = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    if "crawled_at" in first.columns:
        joined = joined.join(first.select("url", F.col("crawled_at").cast("string").alias("_crawled")), "url", "left")
        crawled = F.coalesce("_crawled", crawled)
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    articles = joined.select(
        "page_id", "pos", "url", "title", "publish_time", "content", "author", "source", "description", empty("categories"), empty("tags"), "language", crawled.alias("crawled_at"),
        F.coalesce("success", F.lit(False)).alias("success"), F.when(F.col("success").isNull(), "not fetched").otherwise(F.col("error")).alias("error"),
    )
    counted = success_counts(articles, "page_id")
    if observation is not None:
        good = has_text(F.col("success"), F.col("content"))
        articles = articles.observe(observation, F.count(F.lit(1)).alias("articles"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))
    total = items.groupBy("page_id").agg(F.count("*").alias("total_count"))
    fill = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = pages.select("page_id").join(total, "page_id", "left").join(counted, "page_id", "left").select("page_id", fill("success_count"), fill("failed_count"), fill("total_count"))
    return articles, report
