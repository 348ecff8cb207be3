"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.workspace import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), u > v. A node's smallest neighbour is summed before the shuffle."""
    directed = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = directed.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node that has a smaller one has only that one, and none hangs on it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where((F.col("up") > 0) & (F.col("n") > 1)).count() == 0


def components(edges: DataFrame, space: Workspace, label: str) -> DataFrame:
    """(node, root): every node of ``edges`` (columns a, b) with the smallest node reachable from it.

    Each step is a written table; a hub's edges stay spread, as only its minimum is summed and
    the join back can be split. Ends when all that is left are stars, whose middles are the roots:
    no step is made only to see that it changes nothing. Nulls and loops are left out.
    Only the last step's table stays.
    """
    now, k = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), 0
    while True:
        k += 1
        now = space.keep(_star(space.keep(_star(now, True), f"{label}-large{k}"), False), f"{label}-small{k}")
        for done in (f"{label}-large{k}", f"{label}-small{k - 1}"):
            space.drop(done)
        if _stars(now):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
