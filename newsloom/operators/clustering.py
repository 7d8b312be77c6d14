"""Which URLs of a group follow the main structures: clusters of path templates.

``group`` is the column (or columns) that keeps one page's, list's or site's URLs together.  All
statistics are per template, so what is shuffled is bounded by the templates of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.urls import classify_url, confident_detail, path, segments, url_components
from newsloom.session import checkpointed

#: Least size of a cluster, as a number and as a share of the main one; similarity from which small clusters follow.
LEAST_SIZE, LEAST_SHARE, SIMILAR = 3, 0.1, 0.7


def template(c: Column) -> Column:
    """Path template of URL components: static segments in lower case, ``<kind>`` for the others."""
    return F.array_join(F.zip_with(c["path_segments"], c["segment_types"], lambda s, t: F.when(t == "static", F.lower(s)).otherwise(F.concat(F.lit("<"), t, F.lit(">")))), "/")


def templates_similar(t1: Column, t2: Column, threshold: float = SIMILAR) -> Column:
    a, b = F.split(t1, "/"), F.split(t2, "/")
    dynamic = lambda x: x.startswith("<")
    n = F.least(F.size(a), F.size(b))
    head_a, head_b = F.element_at(a, 1), F.element_at(b, 1)
    points = F.aggregate(
        F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.when(x == y, 1.0).when(dynamic(x) & dynamic(y), 0.5).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v
    )
    heads_differ = ~dynamic(head_a) & ~dynamic(head_b) & (head_a != head_b)
    return ~heads_differ & (F.abs(F.size(a) - F.size(b)) <= 1) & (points / n >= threshold)


def with_structure(urls: DataFrame, url: str = "url") -> DataFrame:
    """URLs with their template, depth, has_date and whether they are stories with confidence."""
    parsed = urls.withColumn("_c", url_components(F.col(url))).withColumn("_kind", classify_url(F.col(url)))
    return parsed.select(
        *urls.columns, template(F.col("_c")).alias("template"), F.size("_c.path_segments").alias("depth"), F.col("_c.has_date_segment").alias("has_date"),
        confident_detail(F.col(url), F.col("_c"), F.col("_kind")).alias("confident"),
    )


def clusters_of(shaped: DataFrame, group: list[str]) -> DataFrame:
    """Clusters of URLs with structure: (group, template, depth, has_date, size, kept)."""
    clusters = shaped.groupBy(*group, "template", "depth", "has_date").agg(F.count("*").alias("size"), F.bool_or("confident").alias("confident"))
    of_group = Window.partitionBy(*group)
    clusters = clusters.select("*", F.max("size").over(of_group).alias("main"), F.sum("size").over(of_group).alias("total")).withColumn(
        "least", F.greatest(F.lit(LEAST_SIZE), F.floor(F.col("main") * LEAST_SHARE))
    )
    everything = (F.col("total") < 3) | (F.col("main") < 2)
    big = F.col("size") >= F.col("least")
    accepted = F.filter(F.collect_set(F.when(big & F.col("confident"), F.col("template"))).over(of_group), lambda t: t.isNotNull())
    follows = ~big & F.exists("accepted", lambda t: templates_similar(F.col("template"), t))
    return clusters.withColumn("accepted", accepted).select(
        *group, "template", "depth", "has_date", "size", (everything | (big & F.col("confident")) | follows).alias("kept")
    )


def kept_urls(shaped: DataFrame, group: list[str], url: str = "url") -> DataFrame:
    """(group, url) whose cluster is kept: a semi join on the template."""
    kept = clusters_of(shaped, group).filter("kept").select(*group, "template", "depth", "has_date")
    return shaped.join(kept, [*group, "template", "depth", "has_date"], "left_semi").select(*group, url)


def structure_clusters(urls: DataFrame, group: list[str], url: str = "url") -> DataFrame:
    """Clusters of each group's distinct URLs: (group, template, depth, has_date, size, kept)."""
    return clusters_of(with_structure(urls.select(*group, url).distinct(), url), group)


def main_structure_urls(urls: DataFrame, group: list[str], url: str = "url") -> DataFrame:
    """The distinct URLs (group, url) of the main structures of each group."""
    return kept_urls(with_structure(urls.select(*group, url).distinct(), url), group, url)


def anchor_urls(urls: DataFrame, group: list[str], url: str = "url") -> DataFrame:
    """URLs that are stories with confidence, within the main structures if enough of them are.

    Fewer than two confident URLs: all are clustered instead.  Fewer than two left by clustering:
    the confident ones stand.  The parsed URLs are written once, since every branch reads them.
    """
    shaped = with_structure(urls.select(*group, url).distinct(), url)
    shaped = checkpointed(shaped)
    # counted by aggregation, not over a window: a group can hold a third of all URLs
    n_sure = shaped.groupBy(*group).agg(F.count_if("confident").alias("n_sure")).alias("n")
    same = [F.col(f"s.{g}").eqNullSafe(F.col(f"n.{g}")) for g in group]
    counted = shaped.alias("s").join(n_sure, same).select("s.*", "n.n_sure")
    sure, unsure = counted.filter("n_sure >= 2 and confident"), counted.filter("n_sure < 2")
    clustered = kept_urls(sure, group, url)
    enough = clustered.groupBy(*group).agg(F.count("*").alias("n")).filter("n >= 2").select(*group)
    stand = sure.select(*group, url).join(enough, group, "left_anti")
    return clustered.join(enough, group, "left_semi").unionByName(stand).unionByName(kept_urls(unsure, group, url))


def learned_static(urls: DataFrame, group: list[str], url: str = "url") -> DataFrame:
    """(group, learned): path segments that occur at least twice in a group's sample URLs."""
    each = urls.select(*group, F.explode(segments(path(F.col(url)))).alias("segment"))
    return each.groupBy(*group, "segment").agg(F.count("*").alias("n")).filter("n >= 2").groupBy(*group).agg(F.collect_set("segment").alias("learned"))
