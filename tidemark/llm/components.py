"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, or only larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node in links, component being its smallest node.

    Null ends, loops and repeated links are ignored. A round takes two
    aggregations of the links, which combine before they shuffle, and two joins
    against a written table, so that a node with very many links is split over
    tasks. Rounds grow with the logarithm of the longest path.
    """
    edges = cut(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col("u") < F.col("v")).distinct())
    n = edges.count()
    while n and not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), 2 * n)
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = cut(small.union(low).select(F.col("v").alias("u"), F.col("u").alias("v")).distinct(), 2 * n)
        n = edges.count()
    ends = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return ends.union(edges.select("u", "u").distinct())
