"""Moments of vector columns and small numeric routines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(column: pa.Array) -> np.ndarray:
    """The vectors of a list column that are not null, as a matrix over its flat values."""
    held = column.drop_null()
    if not len(held):
        return np.zeros((0, 0))
    flat = np.asarray(held.flatten().cast(pa.float64()).fill_null(float("nan")))
    return flat.reshape(len(held), -1)


def gram(df: DataFrame, vector: str, center: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sum of the vectors and X'X, of vectors less ``center`` if given. Each task
    sends one d x d matrix as rows that are summed in the cluster; the driver gets d x d numbers
    at any input size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, s = None, 0, None
        for b in batches:
            x = _rows(b.column(0))
            if not len(x):
                continue
            if center is not None:
                x = x - center
            total = x.T @ x if total is None else total + x.T @ x
            s = x.sum(0) if s is None else s + x.sum(0)
            n += len(x)
        if total is not None:
            flat = np.concatenate([[n], s, total.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    got = df.select(vector).mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    v = got.column("v").to_numpy()
    if not len(v):
        raise ValueError("no rows to fit on")
    d = int((math.isqrt(4 * len(v) - 3) - 1) // 2)
    return int(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)


def means(df: DataFrame, vector: str) -> np.ndarray:
    """The mean of each entry."""
    rows = df.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()  # a row an entry
    if not rows:
        raise ValueError("no rows to fit on")
    return np.array([r["m"] for r in rows], float)


def covariance(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means and sample covariance; vectors are centered first, so data far from 0 lose nothing."""
    middle = means(df, vector)
    n, total, product = gram(df, vector, middle)
    return n, middle + total / n, (product - np.outer(total, total) / n) / max(n - 1, 1)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_quantile(p: float, d1: float, d2: float) -> float:
    """Inverse of the F distribution's cdf by bisection."""
    low, high = 0.0, 1.0
    cdf = lambda v: beta_cdf(d1 * v / (d1 * v + d2), d1 / 2, d2 / 2)
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)
