"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, discard


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of a node moves to the least of the node and its neighbours; and the table of the least."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("least")), "components-least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node and its smaller neighbours move to the least of them; and the table of the least."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("least")), "components-least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v")
    return moved.union(least.select("u", F.col("least").alias("v"))), least


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's least node) of every node of ``edges`` (columns u and v).

    Each round is two joins of edges with one row a node.  Hubs are summed before shuffles, and as that row
    is written first, a hub's edges are split by Spark's skew handling.  The number of rounds grows with the logarithm of a component's size.
    """

    def told(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 30)), F.max("u")).first())

    held = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before, now = None, told(held)
    while now != before and now[0]:
        for star in (_large, _small):
            moved, least = star(held)
            moved = cut(moved.distinct(), "components")
            discard(held, least)
            held = moved
        before, now = now, told(held)
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).union(held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
