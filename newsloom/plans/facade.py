"""From URLs to rows: fetch, decode, and extract, in one declaration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from newsloom.functions.encoding import decoded_page
from newsloom.plans.article import ArticleConfig, parse_articles
from newsloom.plans.collect import collect, list_results
from newsloom.plans.listing import ListConfig, list_items
from newsloom.session import written
from newsloom.sources.web import FetchConfig, fetch, open_url


def fetched_pages(urls: DataFrame, config: FetchConfig = FetchConfig(), opener: Callable = open_url) -> DataFrame:
    """(url, html, error, fetched_at) of each distinct URL of the column ``url``; written once, so that nothing is fetched twice."""
    got = fetch(urls.select("url").filter(F.col("url").isNotNull()).distinct(), config, opener)
    text = decoded_page(F.lit(None).cast("string"), F.col("body"), F.col("content_type"))["text"]
    return written(got.select("url", text.alias("html"), "error", F.current_timestamp().alias("fetched_at")))


def _lists(fetched: DataFrame) -> DataFrame:
    return fetched.select(F.xxhash64("url").alias("page_id"), "url", F.col("url").alias("base_url"), "html", "fetched_at", F.col("error").alias("fetch_error"))


def news_lists(urls: DataFrame, config: ListConfig = ListConfig(), fetching: FetchConfig = FetchConfig(), opener: Callable = open_url) -> DataFrame:
    """(page_id, url, items, total_count, success, error) of the list page at each URL; a page that cannot be fetched is a failure with its error."""
    pages = _lists(fetched_pages(urls, fetching, opener))
    results = list_results(pages, config)
    return results.join(pages.select("page_id", "fetch_error"), "page_id").withColumn("error", F.coalesce("fetch_error", "error")).drop("fetch_error")


def news_articles(urls: DataFrame, config: ArticleConfig = ArticleConfig(), fetching: FetchConfig = FetchConfig(), opener: Callable = open_url) -> DataFrame:
    """The fields of the article at each URL, with ``crawled_at``; a page that cannot be fetched is a failure with its error."""
    pages = fetched_pages(urls, fetching, opener)
    parsed = parse_articles(pages, config=config)
    return parsed.join(pages.select("url", F.col("error").alias("fetch_error"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("crawled_at")), "url").withColumn("error", F.coalesce("fetch_error", "error")).drop("fetch_error")


def collect_news(urls: DataFrame, limit: int = 50, config: ListConfig = ListConfig(), article_config: ArticleConfig = ArticleConfig(), fetching: FetchConfig = FetchConfig(), opener: Callable = open_url, observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """``collect`` of the list pages at the given URLs: lists are fetched, then the articles that they name."""
    pages = _lists(fetched_pages(urls, fetching, opener))
    named = list_items(pages, config=config).filter(F.col("pos") < limit) if limit > 0 else list_items(pages, config=config)
    articles = fetched_pages(named, fetching, opener).select("url", "html", F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("crawled_at"))
    return collect(pages, articles, limit, config, article_config, observation)
