"""Connected components of a link table by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.session import cut, drop


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or has exactly one edge, to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return nodes.filter("child > 1 or (child = 1 and root = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (columns a, b, both bigint, not null).

    `component` is the smallest node reachable.  Large-star and small-star steps
    alternate until every component is a star about its least node; each step is one
    map-side-combined minimum and one join on the node, so a hub is a skewed join key
    that Spark splits, and never a group held by one task.  The tables of a step are
    deleted after the next.  A table without links gives no rows.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows=links.count())
    while not _is_forest_of_stars(edges):
        n = edges.count()  # a star step adds no edge
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(_least_neighbour(both).select("u", F.least("u", "m").alias("m")), rows=2 * n)  # written, so that the join on hubs can be split
        large = cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), rows=n)
        least = _least_neighbour(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, edges = edges, cut(small.distinct(), rows=2 * n)
        for table in (before, low, large):
            drop(table)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
