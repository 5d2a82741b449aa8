"""Connected components of an edge table, without a hot task or a driver loop over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). A row per node that has an edge: node, root (the least node
    of its component). Self-loops, repeated and null edges add nothing.

    Alternating large and small stars: rounds grow with the logarithm of the graph.
    Least neighbours come from an aggregate that combines before its shuffle, and the
    join back has one row a node on one side, so a hub's rows can be split."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Does every node either have one edge to a lesser one, or only edges from larger ones?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()
