"""Connected components by alternating large-star and small-star steps, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import cut, shuffle_partitions

#: Edges of a partition between steps, about; few edges then need few tasks and files.
PART_EDGES = 20_000


def _mark(edges: DataFrame) -> tuple:
    """Edge count and an order-free hash: two numbers that tell whether a step has changed anything."""
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """``edges(a, b)`` of integer ids -> ``(node, component)``, component the smallest id reachable.

    Nodes without an edge are absent; loops, nulls and repeated edges do no harm. Each step moves
    edges only; the driver sees two numbers a step. Minima are aggregated before the shuffle and
    the joins back are plain equi-joins, so a hub's edges can be split by the skew-join rule.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(e)
    for _ in range(max_steps):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = cut(small.coalesce(max(1, min(shuffle_partitions(edges.sparkSession), mark[0] // PART_EDGES))))
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    pairs = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
