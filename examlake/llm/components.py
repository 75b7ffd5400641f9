"""Connected components over an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlake.llm.common import materialize


def _toward_smallest(adjacent: DataFrame) -> DataFrame:
    """adjacent (u, v) with m, the smallest of u and its neighbours; only the minima are grouped."""
    least = adjacent.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return adjacent.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the component's smallest node.

    Large-star and small-star rounds shrink every component to a star around its smallest node.
    Each round is a written table, so a lost executor recomputes one round at most.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialize(now, "cc"), None
    for _ in range(most_rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _toward_smallest(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "cc")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
