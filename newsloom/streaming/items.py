"""News items of a stream of list pages: each URL once within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.listing import ListConfig, list_items


def new_items(pages: DataFrame, event_time: str = "fetched_at", delay: str = "2 days", config: ListConfig = ListConfig()) -> DataFrame:
    """Items of a stream of pages (page_id, html, base_url and an event time), duplicates of a URL dropped.

    State is one entry a URL, dropped when the watermark passes it, so it is bounded by the URLs
    that are seen within the delay.  A page later than the watermark gives nothing.
    """
    # the event time rides in the key through the one step that leaves the JVM
    keyed = pages.select(F.struct(F.col(event_time).alias("at"), F.col("page_id").alias("id")).alias("k"), "html", "base_url")
    flat = keyed.select(F.to_json("k").alias("page_id"), "html", "base_url")
    items = list_items(flat, config=config)
    parsed = items.withColumn("k", F.from_json("page_id", "at timestamp, id bigint")).select(F.col("k.at").alias(event_time), F.col("k.id").alias("page_id"), "pos", "title", "url", "publish_time")
    return parsed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])


def items_per_hour(items: DataFrame, event_time: str = "fetched_at") -> DataFrame:
    """Count of new items by hour."""
    return items.groupBy(F.window(event_time, "1 hour").alias("hour")).agg(F.count("*").alias("items"))
