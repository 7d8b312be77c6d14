"""Similarity of URLs by the kinds of their path segments, and the join that finds similar ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.urls import likely_detail, likely_topic, root_key, same_root, url_components
from newsloom.operators.clustering import learned_static

STRUCTURE_WEIGHT, CONTENT_WEIGHT, THRESHOLD, DEPTH_DIFF = 0.8, 0.2, 0.65, 1


def structure_score(a: Column, b: Column) -> Column:
    """Share of positions whose kinds agree; 0 if the first pair of static segments differs."""
    t1, t2, s1, s2 = a["segment_types"], b["segment_types"], a["path_segments"], b["path_segments"]
    n1, n2 = F.size(t1), F.size(t2)
    pairs = F.zip_with(
        F.arrays_zip(t1.alias("t"), s1.alias("s")), F.arrays_zip(t2.alias("t"), s2.alias("s")),
        lambda x, y: F.struct(
            ((x["t"] == "static") & (y["t"] == "static")).alias("both_static"),
            F.when(x["t"] == y["t"], F.when((x["t"] != "static") | (F.lower(x["s"]) == F.lower(y["s"])), 1.0).otherwise(0.0))
            .when(x["t"].isin("slug", "mixed") & y["t"].isin("slug", "mixed"), 0.5)
            .when(x["t"].isin("number", "mixed") & y["t"].isin("number", "mixed"), 0.3)
            .otherwise(0.0).alias("points"),
        ),
    )
    statics = F.filter(pairs, lambda p: p["both_static"])
    first_differs = F.coalesce(F.try_element_at(statics, F.lit(1))["points"] == 0.0, F.lit(False))
    total = F.aggregate(F.transform(pairs, lambda p: F.coalesce(p["points"], F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return F.when((n1 == 0) & (n2 == 0), 1.0).when((n1 == 0) | (n2 == 0) | first_differs, 0.0).otherwise(total / F.greatest(n1, n2))


def content_score(a: Column, b: Column) -> Column:
    """Jaccard similarity of the static segments; prefixes or dates decide where there are none."""
    static = lambda c: F.array_distinct(
        F.transform(F.filter(F.arrays_zip(c["path_segments"].alias("s"), c["segment_types"].alias("t")), lambda x: x["t"] == "static"), lambda x: F.lower(x["s"]))
    )
    x, y = static(a), static(b)
    p1, p2 = a["prefix_pattern"], b["prefix_pattern"]
    without = F.when(p1.isNotNull() & p2.isNotNull(), F.when(p1 == p2, 1.0).otherwise(0.0)).when(a["has_date_segment"] & b["has_date_segment"], 0.8).otherwise(0.5)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), without).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def similarity(a: Column, b: Column) -> Column:
    """Similarity of two URL components: 0 unless site, depth, type and prefix are compatible."""
    comparable = (
        same_root(a["domain"], b["domain"])
        & (F.abs(F.size(a["path_segments"]) - F.size(b["path_segments"])) <= DEPTH_DIFF)
        & ~(likely_detail(a) & likely_topic(b))
        & ~(likely_topic(a) & likely_detail(b))
        & F.coalesce(a["prefix_pattern"] == b["prefix_pattern"], F.lit(True))
    )
    structure = structure_score(a, b) * F.when(a["extension"] == b["extension"], 1.0).otherwise(0.8)
    return F.when(comparable, structure * STRUCTURE_WEIGHT + content_score(a, b) * CONTENT_WEIGHT).otherwise(0.0)


def similar_urls(samples: DataFrame, candidates: DataFrame, group: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(group, url, score): candidates that are similar to a sample of their group, with their best score.

    An equi join on group and site root with the depth as residual condition.  Samples of a group
    that have the same components but for their numbers are compared once: they are reduced to
    their distinct shapes first, so a group with many samples of one shape costs as one.
    """
    learned = learned_static(samples, group)
    shaped = lambda df: df.join(learned, group, "left").withColumn("c", url_components(F.col("url"), F.coalesce("learned", F.array().cast("array<string>"))))
    shape = F.struct(
        F.col("c.domain").alias("domain"),
        F.zip_with("c.path_segments", "c.segment_types", lambda s, t: F.when(t == "static", F.lower(s)).otherwise("")).alias("path_segments"),
        F.col("c.segment_types").alias("segment_types"), F.col("c.extension").alias("extension"), F.col("c.prefix_pattern").alias("prefix_pattern"), F.col("c.has_date_segment").alias("has_date_segment"),
    )
    s = shaped(samples.select(*group, "url").distinct()).select(*group, shape.alias("a")).distinct().withColumn("root", root_key(F.col("a.domain")))
    c = shaped(candidates.select(*group, "url").distinct()).select(*group, "url", F.col("c").alias("b")).withColumn("root", root_key(F.col("b.domain")))
    near = F.abs(F.size("a.path_segments") - F.size("b.path_segments")) <= DEPTH_DIFF
    scored = c.join(s, [*group, "root"]).filter(near).withColumn("score", similarity(F.col("a"), F.col("b")))
    return scored.groupBy(*group, "url").agg(F.max("score").alias("score")).filter(F.col("score") >= threshold)
