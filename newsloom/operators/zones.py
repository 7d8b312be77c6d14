"""Heat, zones and boundaries of lit links in the node table, without walking trees.

Heat of a node is the number of lit links in its subtree.  The zones are the children of the
lowest common ancestor of all lit links of a page; a zone with one link is that link.  The boundary
of a link is the highest ancestor, at most ``reach`` levels up, that holds no other link of its
zone; the nearest links before and after it in document order decide that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def heat_map(lit: DataFrame) -> DataFrame:
    """(page_id, node, heat).  ``lit``: page_id, node, path."""
    return lit.select("page_id", F.explode("path").alias("node")).groupBy("page_id", "node").agg(F.count("*").alias("heat"))


def hot_zones(lit: DataFrame) -> DataFrame:
    """(page_id, node, path, zone, zone_size, zone_root) of each lit link; pages with fewer than two give no row."""
    of_page = Window.partitionBy("page_id")
    total = F.count("*").over(of_page)
    # the common ancestor is the longest common prefix of the first and the last path in document order
    ends = lit.select("*", total.alias("lit_links"), F.min_by("path", "node").over(of_page).alias("a"), F.max_by("path", "node").over(of_page).alias("b")).filter("lit_links >= 2")
    shared = F.size(F.array_intersect("a", "b"))
    zoned = ends.withColumn("zone", F.element_at("path", F.least(shared + 1, F.size("path")))).drop("a", "b", "lit_links")
    size = F.count("*").over(Window.partitionBy("page_id", "zone"))
    return zoned.withColumn("zone_size", size).withColumn("zone_root", F.when(F.col("zone_size") == 1, F.col("node")).otherwise(F.col("zone")))


def boundaries(zoned: DataFrame, reach: int = 10) -> DataFrame:
    """(page_id, node, zone, boundary): for links that are not nested in one another."""
    w = Window.partitionBy("page_id", "zone").orderBy("node")
    shared = lambda other: F.coalesce(F.size(F.array_intersect("path", other)), F.lit(0))
    depth = F.size("path")
    own = zoned.withColumn("before", F.lag("path").over(w)).withColumn("after", F.lead("path").over(w))
    common = F.greatest(F.when(F.col("before").isNotNull(), shared("before")).otherwise(0), F.when(F.col("after").isNotNull(), shared("after")).otherwise(0))
    return own.select("page_id", "node", "zone", F.element_at("path", F.greatest(F.least(common + 1, depth), depth - reach, F.lit(1))).alias("boundary"))


def within(nodes: DataFrame, roots: DataFrame, root: str) -> DataFrame:
    """Nodes of the subtree of each root: an equi join on the exploded path, no range join."""
    return nodes.select("*", F.explode("path").alias(root)).join(roots, ["page_id", root])
