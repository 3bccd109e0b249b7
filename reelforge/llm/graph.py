"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the edge list, written to the
shared folder.  A star with very many leaves is never gathered: minima are
partial aggregates, and the joins read two plain exchanges, so that adaptive
execution may split a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(u, v) long edges -> (node, label): label is the smallest node reachable.

    Only nodes of some edge are returned.  Self-loops, nulls, repeated edges and
    an empty table are allowed.
    """
    scratch = Scratch(spark, "components")
    now = scratch.put(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    )
    while not _are_stars(now):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = scratch.put(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        scratch.drop(now)
        scratch.drop(low)
        low = scratch.put(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.put(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(large)
        scratch.drop(low)
    return scratch.put(
        now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Every upper node has one neighbour, and no lower node is an upper one."""
    upper = edges.groupBy("a").agg(F.count("*").alias("n"))
    if upper.filter("n > 1").limit(1).count():
        return False
    lower = edges.select(F.col("b").alias("a")).distinct()
    return not lower.join(upper, "a", "left_semi").limit(1).count()
