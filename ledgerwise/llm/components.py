"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.operators.joins import by_merge
from ledgerwise.shared import staged


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``, the component being its smallest node.

    Alternates large-star and small-star steps: rounds grow with the logarithm of the longest path, edges never grow in
    number, and a step only needs the smallest neighbour of each node, which is combined before the shuffle.  The join
    back to a hub's edges is an inner merge join that adaptive execution splits, never a broadcast: nodes grow
    with the edges.  Each round is a written table.  No edges: no rows.  Nulls and loops are ignored.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = staged(now, "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = staged(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Are all edges those of stars, each node being tied to one smallest node that is tied to none?

    One grouping over both ends, combined before the shuffle: no node may have two edges up, or one up and one down.
    """
    both = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    ends = both.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return ends.where("up > 1 or (up = 1 and least = 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node are tied to the smallest of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(by_merge(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Neighbours below a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    below = edges.join(by_merge(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.union(least.select("a", F.col("m").alias("b"))).distinct()
