"""Connected components of an edge table, by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, group): each node of edges (a, b) with the smallest node that it is connected to; nodes without edges aren't there.

    Loops and repeated edges don't matter. Every round is one or two shuffles of the edges and is checkpointed; the rounds
    grow with the logarithm of the longest path. A node of many neighbours is never gathered in one row.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        # Large star: every neighbour that is larger than the node points to the node's smallest neighbour.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every neighbour that is no larger, and the node itself, points to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = cut(small)
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    groups = e.select(F.col("a").alias("id"), F.col("b").alias("group"))
    return groups.union(e.select(F.col("b").alias("id"), F.col("b").alias("group")).distinct())
