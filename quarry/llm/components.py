"""Connected components over an edge table, by alternating star contraction.

Every step is a grouped minimum and an equi-join, so no node's neighbours meet
in one task: the minimum is combined before the shuffle, and the join's sides
are both plain tables, which lets a hub be split by the skew-join rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def _least(df: DataFrame) -> DataFrame:
    return df.groupBy("a").agg(F.min("b").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the least node.

    Null ends and loops are ignored.  An empty edge table gives an empty result.
    """
    clean = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    now = materialize(clean, "edges")
    mark = _mark(now)
    if mark[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        # Large star: each node hands its greater neighbours to its least neighbour.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(_least(both).select("a", F.least("a", "m").alias("m")), "least")
        large = materialize(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: each node hands its lesser neighbours, and itself, to the least.
        low2 = materialize(_least(large), "least")
        small = large.join(low2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.unionByName(low2.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for old in (low, large, low2, now):
            release(old)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
