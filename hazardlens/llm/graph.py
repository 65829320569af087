"""Connected components of an edge table, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v. Large: every node's larger
    neighbours, and small: its smaller ones and itself, move to the smallest
    node that it knows. Minima are aggregated before the shuffle; a node with
    many neighbours is split by the join like any skewed key."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u").where("v > u")
        return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): the component is the
    smallest node reachable. Each round is written to shared storage; the
    number of rounds grows with the logarithm of the longest chain."""
    now = (edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now = stored(now, "components")
    before = None
    for _ in range(max_rounds):
        size = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if before == size:
            break
        before = size
        now = stored(_star(_star(now, True), False), "components")
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
