"""Tanimoto counts and neighbours of packed bit vectors: blocks of rows meet in Arrow batches, where a pair costs a few
vector instructions instead of a row.

Every row of one side is held against every row of the other that its number of set bits allows; results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity

#: A side is cut in up to PARTS blocks of ``LEAST`` rows or more, and in more where a block would have over ``MOST`` words.
PARTS, LEAST, MOST = 8, 8_192, 1 << 19
#: Rows and columns that are compared at once, so that their words stay in the cache.
TALL, WIDE = 64, 2_048


def _blocks(rows: int, words: int) -> int:
    return max(1, min(PARTS, -(-rows // LEAST)), -(-rows * words // MOST))


def _met(left: DataFrame, right: DataFrame, width: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """``run`` of each block of ``left`` (i, _x) with each of ``right`` (j, _y); rows without bits are left out."""
    left, right = left.filter(similarity.ones(F.col("_x"), width).isNotNull()), right.filter(similarity.ones(F.col("_y"), width).isNotNull())
    words = -(-width // similarity.BITS)
    n, m = _blocks(left.count(), words), _blocks(right.count(), words)
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    one = left.withColumn("_b", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")).withColumn("_c", each(m))
    two = right.withColumn("_c", F.pmod(F.xxhash64("j"), F.lit(m)).cast("int")).withColumn("_b", each(n))
    keys = ["_b", "_c"]
    return one.repartition(n * m, *keys).groupBy(*keys).cogroup(two.repartition(n * m, *keys).groupBy(*keys)).applyInArrow(run, schema)


def _words(column: pa.ChunkedArray, words: int) -> np.ndarray:
    """Words of the vectors, a row each word."""
    flat = pc.list_flatten(column).to_numpy().astype(np.int64, copy=False).view(np.uint64)
    return np.ascontiguousarray(flat.reshape(len(column), -1)[:, :words].T)


def _set(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(0, dtype=np.int64)


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.bitwise_count(x[0][:, None] & y[0][None])
    if len(x) > 1:
        out = out.astype(np.uint16)
        for a, b in zip(x[1:], y[1:], strict=True):
            out += np.bitwise_count(a[:, None] & b[None])
    return out


def _ratio(shared: np.ndarray, p: np.ndarray | int, q: np.ndarray) -> np.ndarray:
    union = p + q - shared
    return np.where(union == 0, 1.0, shared / np.maximum(union, 1))


def weighed_links(x: np.ndarray, y: np.ndarray, weight: np.ndarray, threshold: float, width: int) -> np.ndarray:
    """For each vector of ``x`` the summed weight of those of ``y`` with similarity at least ``threshold``."""
    out = np.zeros(x.shape[1], np.int64)
    p, q = _set(x), _set(y)
    shared, count = np.arange(width + 1)[None], np.arange(width + 1)[:, None]
    parts = []
    for chosen in (weight == 1, weight != 1):
        order = np.flatnonzero(chosen)
        order = order[np.argsort(q[order], kind="stable")]
        parts.append((np.ascontiguousarray(y[:, order]), q[order], weight[order].astype(float)))
    for ones in np.unique(p):
        enough = (_ratio(shared, ones, count) >= threshold) & (shared <= np.minimum(ones, count))
        fit = np.flatnonzero(enough.any(1))  # numbers of bits that a vector of y can have, one after another
        if not len(fit):
            continue
        least = enough.argmax(1).astype(np.uint16 if width > 255 else np.uint8)
        rows = np.flatnonzero(p == ones)
        for k, (held, bits, w) in enumerate(parts):
            low, high = np.searchsorted(bits, fit[0]), np.searchsorted(bits, fit[-1], "right")
            for r in range(0, len(rows), TALL):
                some = rows[r : r + TALL]
                asked = np.ascontiguousarray(x[:, some])
                for c in range(low, high, WIDE):
                    to = min(c + WIDE, high)
                    hits = _shared(asked, held[:, c:to]) >= least[bits[c:to]]
                    out[some] += np.rint(hits @ w[c:to]).astype(np.int64) if k else np.count_nonzero(hits, axis=1)
    return out


def nearest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, similarity) of the ``k`` most similar rows of ``y`` to each of ``x``, of equal ones the first.

    Rows of ``y`` come in the order in which their numbers of bits bound the similarity, so the
    search for a row ends where no later one can reach its k-th best. Equal vectors are searched once.
    """
    _, first, place = np.unique(x, axis=1, return_index=True, return_inverse=True)
    place = place.ravel()
    order = np.lexsort((np.arange(y.shape[1]), *y))
    new = np.ones(len(order), bool)
    new[1:] = (y[:, order[1:]] != y[:, order[:-1]]).any(0)
    starts = np.flatnonzero(new)
    kept = np.sort(order[np.arange(len(order)) - starts[np.cumsum(new) - 1] < k])  # no more than k copies can count
    y, p = y[:, kept], _set(x[:, first])
    q = _set(y)
    best, held = np.full((len(first), k), -1.0), np.full((len(first), k), -1)
    for ones in np.unique(p):
        bound = np.where(np.maximum(q, ones) == 0, 1.0, np.minimum(q, ones) / np.maximum(np.maximum(q, ones), 1))
        order = np.argsort(-bound, kind="stable")
        bound, bits, columns = bound[order], q[order], np.ascontiguousarray(y[:, order])
        rows = np.flatnonzero(p == ones)
        for r in range(0, len(rows), TALL):
            some = rows[r : r + TALL]
            asked = np.ascontiguousarray(x[:, first[some]])
            top, who = np.full((len(some), k), -1.0), np.full((len(some), k), -1)
            c = 0
            while c < len(order) and bound[c] >= top[:, -1].min():
                to = min(len(order), c + (WIDE if c else TALL))
                shared = _shared(asked, columns[:, c:to])
                last = top[:, -1]
                need = np.where(last < 0, 0, np.ceil(last * (ones + bits[c:to].min()) / (1 + np.maximum(last, 0)) - 1e-6))
                a, b = np.nonzero(shared >= need[:, None].astype(shared.dtype))
                value = _ratio(shared[a, b].astype(np.int64), int(ones), bits[c:to][b])
                good = value >= last[a]
                if good.any():
                    a, value, found = a[good], value[good], order[c:to][b[good]]
                    at = np.concatenate([np.repeat(np.arange(len(some)), k), a])
                    value, found = np.concatenate([top.ravel(), value]), np.concatenate([who.ravel(), found])
                    by = np.lexsort((found, -value, at))
                    at = at[by]
                    rank = np.arange(len(at)) - np.searchsorted(at, at)
                    in_time = rank < k
                    top[at[in_time], rank[in_time]], who[at[in_time], rank[in_time]] = value[by][in_time], found[by][in_time]
                c = to
            best[some], held[some] = top, who
    at, rank = np.nonzero(held[place] >= 0)
    return at, kept[held[place][at, rank]], best[place][at, rank]


def tanimoto_links(x: DataFrame, y: DataFrame, x_id: str, x_bits: str, y_bits: str, weight: str, threshold: float, width: int) -> DataFrame:
    """(i, links): for each row of ``x`` the summed ``weight`` (long) of the rows of ``y`` with Tanimoto similarity at
    least ``threshold``; rows with none are left out. Two empty vectors have similarity 1."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    words = -(-width // similarity.BITS)
    left = x.select(F.col(x_id).alias("i"), F.col(x_bits).alias("_x"))
    right = y.select(F.xxhash64(y_bits).alias("j"), F.col(y_bits).alias("_y"), F.col(weight).cast("bigint").alias("_w"))

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        n = np.zeros(len(one), np.int64)
        if len(one) and len(two):
            n = weighed_links(_words(one["_x"], words), _words(two["_y"], words), two["_w"].to_numpy(), threshold, width)
        return pa.table([one["i"], pa.array(n, pa.int64())], names=["i", "links"])

    met = _met(left, right, width, run, T.StructType([left.schema["i"], T.StructField("links", T.LongType())]))
    return met.groupBy("i").agg(F.sum("links").alias("links")).filter("links <> 0")


def tanimoto_knn(queries: DataFrame, rows: DataFrame, q_id: str, r_id: str, q_vec: str, r_vec: str, k: int, width: int) -> DataFrame:
    """(i, j, distance, rank): the k nearest rows of each query by Tanimoto distance; ties by the row's id.

    A block of rows sends k of them for each query. Two empty vectors have distance 0.
    """
    words = -(-width // similarity.BITS)
    left = queries.select(F.col(q_id).alias("i"), F.col(q_vec).alias("_x"))
    right = rows.select(F.col(r_id).alias("j"), F.col(r_vec).alias("_y"))

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        at, found, value = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        if len(one) and len(two):
            two = two.take(pc.sort_indices(two["j"], null_placement="at_start"))
            at, found, value = nearest(_words(one["_x"], words), _words(two["_y"], words), k)
        return pa.table([one["i"].take(pa.array(at)), two["j"].take(pa.array(found)), pa.array(1 - value)], names=["i", "j", "distance"])

    met = _met(left, right, width, run, T.StructType([left.schema["i"], right.schema["j"], T.StructField("distance", T.DoubleType())]))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))).filter(F.col("rank") <= k)
