"""Connected components of a graph of long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import drop_frozen, freeze


def _large_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = e.union(e.select(F.col("b"), F.col("a"))).toDF("a", "b")
    low = freeze(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "large-star")
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), low


def _small_star(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = freeze(down.groupBy("a").agg(F.min("b").alias("m")), "small-star")
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct(), low


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of long ids -> (node, component) for every node that has an edge to another node; the component
    is its smallest node id. Self-loops, null ends and repeated edges are ignored; no edges give no rows.

    A round costs four shuffles of the edges. Each star step takes a minimum per node (combined before the shuffle)
    and joins it back to the edges; the minimum is a stored table, so both join inputs are plain exchanges and the
    adaptive planner can split a hub's edges. Rounds needed grow with the logarithm of the longest path. Tables of
    earlier rounds are deleted.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    e = freeze(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "edges")
    for _ in range(max_rounds):
        # Settled: no node has two parents, or a parent that has one itself.
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x"))
        if ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            break
        large, low = _large_star(e)
        large = freeze(large, "large-stars")
        small, lower = _small_star(large)
        before, e = e, freeze(small, "stars")
        drop_frozen(before, low, large, lower)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
