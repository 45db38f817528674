"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staging


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one root and no root has another: then the edges are the answer."""
    per_node = edges.groupBy("u").agg(F.count("*").alias("n"))
    roots = edges.select(F.col("v").alias("u")).distinct()
    clash = per_node.join(roots.withColumn("r", F.lit(1)), "u", "left").filter("n > 1 or r is not null")
    return not clash.limit(1).count()


def components(edges: DataFrame, stage: Staging, name: str, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of an edge (u, v); the root is the component's least node.

    Each round is written, so lineage stays short; it ends when only stars are left, each node
    tied to its root. Every round keeps the least node of a component reachable from all others,
    so stars of larger nodes that touch are merged before that.
    """
    now = stage.put(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    for k in range(1, rounds + 1):
        if _settled(now):
            break
        after = stage.put(_small_star(_large_star(now)), f"{name}-{k}")
        stage.drop(f"{name}-{k - 1}")
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
