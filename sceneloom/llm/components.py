"""Connected components of a graph that may be as large as the input, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of edges (a, b). Nodes without edges aren't listed.

    Each turn keeps, for every node, edges to the smallest neighbour only; the number of turns grows with the logarithm
    of the longest path. Edge lists stay distributed and are written to the shared folder between turns; smallest
    neighbours come from partial aggregation and joins that adaptive execution can split, so one node may have any number of edges.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    before = _mark(now)
    while before[0]:
        last, now = now, staged(_small_star(_large_star(now)), "cc-edges")
        drop_staged(last)
        after = _mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets the node's smallest neighbour (or the node itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, get the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
