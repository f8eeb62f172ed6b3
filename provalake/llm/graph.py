"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provalake.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the larger (or the smaller) neighbours of each node to the least id of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if large:
        tied = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return tied.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`id` and `component` (the smallest reachable id) of every node that has an edge; edges are (a, b) longs.

    Each round is one aggregate and one join in each direction and is written to the shared folder; the number of rounds
    grows with the logarithm of the longest path. A node with very many neighbours is met by partial aggregates and by
    joins whose large side Spark can split.
    """
    current = stored(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        current = stored(_star(_star(current, True), False), "edges")
    return current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
        current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
