"""Bulk similarity, nearest neighbours and threshold joins of vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity

#: A query side of at most so many rows is broadcast; a larger one is dealt out in blocks.
BROADCAST_ROWS = 20_000


def pair_join(x: DataFrame, y: DataFrame, x_id: str, y_id: str, x_vec: str, y_vec: str, value: Callable[[Column, Column], Column], name: str = "value", block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(i, j, value) for every row of ``x`` with every row of ``y``.

    The result has a row for each pair by definition. A small ``x`` is broadcast after a count;
    a larger one is cut into hashed blocks of some ``block_rows`` rows, every row of ``y`` is sent
    to each block once, and pairs meet in an equi-join on the block, so no task holds all of ``x``.
    """
    left = x.select(F.col(x_id).alias("i"), F.col(x_vec).alias("_x"))
    right = y.select(F.col(y_id).alias("j"), F.col(y_vec).alias("_y"))
    return crossed(left, right, block_rows).select("i", "j", value(F.col("_x"), F.col("_y")).alias(name))


def crossed(left: DataFrame, right: DataFrame, block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of ``left`` (with i) beside every row of ``right``, in blocks of ``left``."""
    rows = left.count()
    if rows <= block_rows:
        return right.crossJoin(F.broadcast(left))
    n = F.lit(-(-rows // block_rows)).cast("bigint")
    dealt = right.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return left.withColumn("_b", F.pmod(F.xxhash64("i"), n)).join(dealt, "_b").drop("_b")


def bulk_similarity(x: DataFrame, y: DataFrame, x_id: str, y_id: str, vec: str, family: str, width: int, counts: bool = False) -> DataFrame:
    """(i, j, similarity, distance) of all pairs by a family of ``similarity.BINARY`` or, for
    ``counts``, ``similarity.COUNT``.

    What belongs to one row (set bits, squared norm) is computed before the rows meet, what belongs
    to a pair once in generated code.
    """
    own = (lambda c: similarity.dot(c, c, width)) if counts else (lambda c: similarity.ones(c, width))
    left = x.select(F.col(x_id).alias("i"), F.col(vec).alias("_x"), own(F.col(vec)).cast("double").alias("_p"))
    right = y.select(F.col(y_id).alias("j"), F.col(vec).alias("_y"), own(F.col(vec)).cast("double").alias("_q"))
    both = (similarity.dot if counts else similarity.shared_ones)(F.col("_x"), F.col("_y"), width).cast("double")
    met = crossed(left, right).select("i", "j", "_p", "_q", both.alias("_a"))
    if counts:
        sim = similarity.COUNT[family](F.col("_a"), F.col("_p"), F.col("_q"))
        return met.select("i", "j", sim.alias("similarity")).withColumn("distance", 1 - F.col("similarity"))
    table = (F.col("_a"), F.col("_p") - F.col("_a"), F.col("_q") - F.col("_a"), F.lit(float(width)) - F.col("_p") - F.col("_q") + F.col("_a"))
    out = met.select("i", "j", similarity.BINARY[family](*table).alias("similarity"), *([similarity.NORMALIZED[family](*table).alias("_n")] if family in similarity.NORMALIZED else []))
    return out.select("i", "j", "similarity", (1 - F.col("_n" if family in similarity.NORMALIZED else "similarity")).alias("distance"))


def knn_join(queries: DataFrame, rows: DataFrame, q_id: str, r_id: str, q_vec: str, r_vec: str, distance: Callable[[Column, Column], Column], k: int, exclude_self: bool = False) -> DataFrame:
    """(i, j, distance, rank): the k nearest rows of each query; ties by the row's id.

    Each task keeps its own k best of a query before the shuffle, so a query sends k rows a task.
    """
    pairs = pair_join(queries, rows, q_id, r_id, q_vec, r_vec, distance, "distance")
    if exclude_self:
        pairs = pairs.filter("i <> j")
    own = Window.partitionBy("i", "_part").orderBy("distance", "j")
    local = pairs.withColumn("_part", F.pmod(F.xxhash64("j"), F.lit(16))).withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))).filter(F.col("rank") <= k).select("i", "j", "distance", "rank")


def tanimoto_join(x: DataFrame, y: DataFrame, x_id: str, y_id: str, x_bits: str, y_bits: str, threshold: float, width: int | None = None, rows_per_key: int = 20_000) -> DataFrame:
    """(i, j, similarity) of packed vectors with Tanimoto similarity at least ``threshold``.

    T(x, y) >= t needs t|x| <= |y| <= |x|/t, so a row of ``x`` only meets rows whose bit count is
    in that range: an equi-join on the count of ``y`` and a salt of it. The salt follows the most
    usual count of ``y``, so a key holds some ``rows_per_key`` rows at most. Two empty vectors have
    similarity 1.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    left = x.select(F.col(x_id).alias("i"), F.col(x_bits).alias("_x"), similarity.ones(F.col(x_bits), width).alias("_p"))
    right = y.select(F.col(y_id).alias("j"), F.col(y_bits).alias("_y"), similarity.ones(F.col(y_bits), width).alias("_q"))
    most = right.groupBy("_q").count().agg(F.max("count")).first()[0] or 0
    salts = F.lit(max(1, -(-most // rows_per_key))).cast("bigint")
    low, high = F.ceil(F.col("_p") * threshold - 1e-9).cast("int"), F.floor(F.col("_p") / threshold + 1e-9).cast("int")
    spread = left.withColumn("_q", F.explode(F.sequence(low, high))).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    met = spread.join(right.withColumn("_s", F.pmod(F.xxhash64("j"), salts)), ["_q", "_s"])
    met = met.select("i", "j", "_p", "_q", similarity.shared_ones(F.col("_x"), F.col("_y"), width).cast("double").alias("_a"))
    union = F.col("_p") + F.col("_q") - F.col("_a")
    return met.select("i", "j", F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide("_a", union)).alias("similarity")).filter(F.col("similarity") >= threshold)
