"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import kept


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.where("v > u").join(least.hint("merge"), F.col("u") == F.col("k"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Needs v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("k"), "m")
    joined = edges.join(least.hint("merge"), F.col("u") == F.col("k"))
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("k").alias("u"), F.col("m").alias("v"))
    return moved.union(own).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``: root is the smallest node of its component.

    Nodes are longs. Joins merge: broadcasts, one for each step, would pile up on the driver. Each round is two steps of aggregates and equi-joins; rounds grow with the logarithm of a
    component's width. A hub is not split: its edges, two numbers each, pass through one task, as adaptive execution does not split a join
    with an aggregate. Edges stay on the
    executors, and every round is checkpointed. Roots themselves are not listed.
    """
    edges = edges.where("u <> v").select(
        F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")
    )
    edges = kept(edges.distinct())
    state = None
    while True:
        # Each step reads its input several times, so each is written before the next.
        edges = kept(_large_star(edges))
        edges = kept(_small_star(edges))
        checks = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(checks) == state:
            break
        state = tuple(checks)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
