"""Applicability domain: each fit returns a model with ``score`` and ``predict`` over DataFrames.

Vectors are ``array<double>`` columns. A model holds numbers of the size of a vector or a
d x d matrix, never rows, except the nearest-neighbour and hull models, which keep the training
DataFrame or a bounded set of its points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.moments import _rows, covariance, f_quantile, gram, means
from .pairs import knn_join
from .running import exact_percentiles


def _const(values) -> Column:
    """Numbers as one literal that folds, not an expression each: a 64 x 64 matrix has 4,096."""
    held = ",".join(repr(float(v)) for v in values)
    return F.split(F.lit(held), ",").cast("array<double>") if held else F.array().cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


@dataclass
class Scored:
    """A model whose score is a Column of the vector and whose verdict compares it with a threshold."""

    score_of: Callable[[Column], Column]
    inside: Callable[[Column], Column]

    def score(self, df: DataFrame, vector: str, out: str = "score") -> DataFrame:
        return df.withColumn(out, self.score_of(F.col(vector)))

    def predict(self, df: DataFrame, vector: str, out: str = "inside") -> DataFrame:
        return df.withColumn(out, self.inside(self.score_of(F.col(vector))))


def bounding_box(train: DataFrame, vector: str, lower: float | str = 0, upper: float | str = 100, allowed_violations: int = 0) -> Scored:
    """Score: features inside [percentile lower, percentile upper] of training (or mean - or + 3
    population standard deviations for "three_sigma"); inside if at most so many are not."""
    for p in (lower, upper):
        if p != "three_sigma" and not (isinstance(p, (int, float)) and 0 <= p <= 100):
            raise ValueError("percentiles must be 0 to 100 or three_sigma")
    long = train.select(F.posexplode(vector).alias("i", "v"))
    sigma = lambda sign: F.avg("v") + sign * 3 * F.stddev_pop("v")
    table = long.groupBy("i").agg(sigma(-1).alias("lo_s"), sigma(1).alias("hi_s"))
    shares = [0.0 if lower == "three_sigma" else lower / 100, 1.0 if upper == "three_sigma" else upper / 100]
    table = table.join(exact_percentiles(long, "i", "v", shares), "i")
    low, high = ("lo_s" if lower == "three_sigma" else "p0"), ("hi_s" if upper == "three_sigma" else "p1")
    rows = table.select("i", F.col(low).alias("lo"), F.col(high).alias("hi")).orderBy("i").collect()  # a row a feature
    lo, hi = _const(r["lo"] for r in rows), _const(r["hi"] for r in rows)
    box = F.arrays_zip(lo.alias("lo"), hi.alias("hi"))
    count = lambda x: F.aggregate(F.zip_with(x.cast("array<double>"), box, lambda v, b: ((v >= b["lo"]) & (v <= b["hi"])).cast("int")), F.lit(0), lambda s, v: s + v)
    return Scored(count, lambda s: s >= len(rows) - allowed_violations)


def _true(values: Column) -> Column:
    return _sum(F.transform(values, lambda v: v.cast("double")))


def _share(values: Column, size: Column) -> Column:
    return F.try_divide(_true(values), size)


def _cosine(x: Column, y: Column) -> Column:
    return 1 - F.try_divide(_sum(F.zip_with(x, y, lambda a, b: a * b)), F.sqrt(_sum(F.transform(x, lambda a: a * a)) * _sum(F.transform(y, lambda a: a * a))))


def _table(x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """Entries not 0 in both, in x only, in y only, in neither."""
    of = lambda p, q: _true(F.zip_with(x, y, lambda a, b: ((a != 0) == p) & ((b != 0) == q)))
    return of(True, True), of(True, False), of(False, True), of(False, False)


def _over_both(x: Column, y: Column, differ: Callable, weight: float) -> Column:
    """Share of entries that differ beside those common to both, which weigh ``weight``; two empty vectors: 0."""
    apart, both = _true(F.zip_with(x, y, differ)), _table(x, y)[0]
    return F.coalesce(F.try_divide(apart, weight * both + apart), F.lit(0.0))


def _different(x: Column, y: Column) -> Column:
    """Jaccard distance of the entries not 0 in either."""
    apart = _true(F.zip_with(x, y, lambda a, b: (a != b) & ((a != 0) | (b != 0))))
    return F.coalesce(F.try_divide(apart, _true(F.zip_with(x, y, lambda a, b: (a != 0) | (b != 0)))), F.lit(0.0))


def _rogers(x: Column, y: Column) -> Column:
    a, b, c, d = _table(x, y)
    return F.try_divide(2 * (b + c), a + d + 2 * (b + c))


def _yule(x: Column, y: Column) -> Column:
    a, b, c, d = _table(x, y)
    return F.when(b * c == 0, F.lit(0.0)).otherwise(F.try_divide(2 * b * c, a * d + b * c))


def _percentile(values: DataFrame, share: float) -> float:
    """Of the column ``v``."""
    return float(exact_percentiles(values.withColumn("k", F.lit(0)), "k", "v", [share]).first()["p0"])


VECTOR_METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": lambda x, y: F.sqrt(_sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))),
    "sqeuclidean": lambda x, y: _sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))),
    "cityblock": lambda x, y: _sum(F.zip_with(x, y, lambda a, b: F.abs(a - b))),
    "chebyshev": lambda x, y: F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b))),
    "canberra": lambda x, y: _sum(F.zip_with(x, y, lambda a, b: F.coalesce(F.try_divide(F.abs(a - b), F.abs(a) + F.abs(b)), F.lit(0.0)))),
    "braycurtis": lambda x, y: F.try_divide(_sum(F.zip_with(x, y, lambda a, b: F.abs(a - b))), _sum(F.zip_with(x, y, lambda a, b: F.abs(a + b)))),
    "minkowski": lambda x, y: F.sqrt(_sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))),
    "correlation": lambda x, y: _cosine(F.transform(x, lambda a: a - _sum(x) / F.size(x)), F.transform(y, lambda a: a - _sum(y) / F.size(y))),
    "hamming": lambda x, y: _share(F.zip_with(x, y, lambda a, b: a != b), F.size(x)),
    "dice": lambda x, y: _over_both(x, y, lambda a, b: a != b, 2.0),
    "jaccard": lambda x, y: _different(x, y),
    "rogerstanimoto": lambda x, y: _rogers(x, y),
    "russellrao": lambda x, y: 1 - _share(F.zip_with(x, y, lambda a, b: (a != 0) & (b != 0)), F.size(x)),
    "sokalmichener": lambda x, y: _rogers(x, y),
    "sokalsneath": lambda x, y: _over_both(x, y, lambda a, b: (a != 0) != (b != 0), 0.5),
    "yule": lambda x, y: _yule(x, y),
    "cosine": lambda x, y: 1 - F.try_divide(_sum(F.zip_with(x, y, lambda a, b: a * b)), F.sqrt(_sum(F.transform(x, lambda a: a * a)) * _sum(F.transform(y, lambda a: a * a)))),
}


def distance_to_centroid(train: DataFrame, vector: str, threshold: float | str = "auto", metric: str | Callable = "euclidean") -> Scored:
    """Score: distance to the mean training vector; inside up to the threshold (auto: the 99th
    percentile of training distances). The metric is one of VECTOR_METRICS, "mahalanobis" (training
    covariance), "seuclidean" (training variances) or a function of two array columns."""
    if metric in ("mahalanobis", "seuclidean"):
        _, middle, cov = covariance(train, vector)
        inner = _quadratic(np.linalg.pinv(cov if metric == "mahalanobis" else np.diag(np.diag(cov))), middle)
        score = lambda x: F.sqrt(F.greatest(inner(x), F.lit(0.0)))
    else:
        if isinstance(metric, str) and metric not in VECTOR_METRICS:
            raise ValueError(f"unknown metric {metric}")
        measure = VECTOR_METRICS[metric] if isinstance(metric, str) else metric
        center = _const(means(train, vector))
        score = lambda x: measure(x.cast("array<double>"), center)
    limit = _percentile(train.select(score(F.col(vector)).alias("v")), 0.99) if threshold == "auto" else float(threshold)
    return Scored(score, lambda s: s <= limit)


def response_range(train: DataFrame, y: str, threshold: float | None = None) -> Scored:
    """Score: distance of a predicted response to the training mean; inside within the training
    range, or within ``threshold`` of the mean. The scored column is the response itself."""
    r = train.agg(F.min(y).alias("a"), F.max(y).alias("b"), F.avg(y).alias("m")).first()
    a, b = (r["a"], r["b"]) if threshold is None else (r["m"] - threshold, r["m"] + threshold)
    return _Response(lambda v: F.abs(v - F.lit(float(r["m"]))), lambda s: s, float(a), float(b))


@dataclass
class _Response(Scored):
    low: float = 0.0
    high: float = 0.0

    def predict(self, df: DataFrame, vector: str, out: str = "inside") -> DataFrame:
        return df.withColumn(out, F.col(vector).between(self.low, self.high))


def _quadratic(matrix: np.ndarray, center: np.ndarray) -> Callable[[Column], Column]:
    """x -> (x - center)' matrix (x - center), one inner product a row of the matrix."""

    def score(x: Column) -> Column:
        shifted = F.zip_with(x.cast("array<double>"), _const(center), lambda a, b: a - b)
        rows = F.array(*[_const(r) for r in matrix])
        return _sum(F.zip_with(shifted, rows, lambda v, r: v * _sum(F.zip_with(shifted, r, lambda a, b: a * b))))

    return score


def leverage(train: DataFrame, vector: str, threshold: float | str = "auto") -> Scored:
    """Score: x'(X'X)^-1 x; inside up to 3(d+1)/n."""
    n, _, product = gram(train, vector)
    d = len(product)
    limit = 3 * (d + 1) / n if threshold == "auto" else float(threshold)
    return Scored(_quadratic(np.linalg.pinv(product), np.zeros(d)), lambda s: s <= limit)


def hotelling_t2(train: DataFrame, vector: str, alpha: float = 0.1) -> Scored:
    """Score: squared Mahalanobis distance; inside up to p(n-1)(n+1)/(n(n-p)) F^-1(alpha; p, n-p)."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    n, mean, cov = covariance(train, vector)
    p = len(mean)
    limit = p * (n - 1) * (n + 1) / (n * (n - p)) * f_quantile(alpha, p, n - p)
    return Scored(_quadratic(np.linalg.pinv(cov), mean), lambda s: s <= limit)


def pca_box(train: DataFrame, vector: str, components: int | float | None = None, whiten: bool = False) -> Scored:
    """Inside if every principal score lies in its training range; the score is that verdict."""
    _, mean, cov = covariance(train, vector)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    k = len(values) if components is None else components
    if isinstance(k, float):
        k = int(np.searchsorted(np.cumsum(values) / values.sum(), k) + 1)
    axes = vectors[:, :k].T / (np.sqrt(np.maximum(values[:k], 1e-300))[:, None] if whiten else 1)
    project = lambda x: F.array(*[_sum(F.zip_with(F.zip_with(x.cast("array<double>"), _const(mean), lambda a, b: a - b), _const(a_), lambda p, q: p * q)) for a_ in axes])
    ranges = train.select(F.posexplode(project(F.col(vector))).alias("i", "v")).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i").collect()
    box = F.arrays_zip(_const(r["lo"] for r in ranges).alias("lo"), _const(r["hi"] for r in ranges).alias("hi"))
    verdict = lambda x: F.forall(F.zip_with(project(x), box, lambda v, b: (v >= b["lo"] - 1e-9) & (v <= b["hi"] + 1e-9)), lambda ok: ok)
    return Scored(verdict, lambda s: s)


def topkat(train: DataFrame, vector: str, threshold: float | None = None) -> Scored:
    """Score: distance in the optimum prediction space (features scaled to [-1, 1], a constant one
    added, projected on the eigenvectors of S'S); inside below 5d/(2n)."""
    ranges = train.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i").collect()
    low, width = np.array([r["lo"] for r in ranges]), np.array([r["hi"] - r["lo"] for r in ranges])
    middle, width = 2 * low + width, np.where(width == 0, 1, width)  # a feature that is constant in training is 0 there
    scaled = lambda x: F.concat(F.zip_with(F.zip_with(x.cast("array<double>"), _const(middle), lambda a, b: 2 * a - b), _const(width), lambda a, w: a / w), F.array(F.lit(1.0)))
    n, _, product = gram(train.select(scaled(F.col(vector)).alias("_s")), "_s")
    values, vectors = np.linalg.eigh(product)
    values = np.where(np.abs(values) < 1e-10, np.inf, values)
    inner = _quadratic((vectors / values) @ vectors.T, np.zeros(len(values)))
    limit = 5 * len(low) / (2 * n) if threshold is None else threshold
    return Scored(lambda x: inner(scaled(x)), lambda s: s < limit)


def _nearest(df: DataFrame, train: DataFrame, id_col: str, train_id: str, one: str, two: str, metric: Callable[[Column, Column], Column], k: int, nearest: Callable[..., DataFrame] | None) -> DataFrame:
    return nearest(df, train, id_col, train_id, one, two, k) if nearest else knn_join(df, train, id_col, train_id, one, two, metric, k)


@dataclass
class Neighbours:
    train: DataFrame
    train_id: str
    vector: str
    metric: Callable[[Column, Column], Column]
    k: int
    agg: str
    limit: float
    nearest: Callable[..., DataFrame] | None = None

    def score(self, df: DataFrame, id_col: str, vector: str) -> DataFrame:
        """(id, score): the aggregated distance of the k+1 nearest training rows."""
        near = _nearest(df, self.train, id_col, self.train_id, vector, self.vector, self.metric, self.k, self.nearest)
        return near.groupBy(F.col("i").alias(id_col)).agg(getattr(F, {"mean": "avg"}.get(self.agg, self.agg))("distance").alias("score"))

    def predict(self, df: DataFrame, id_col: str, vector: str) -> DataFrame:
        return self.score(df, id_col, vector).withColumn("inside", F.col("score") <= self.limit)


def knn_domain(train: DataFrame, id_col: str, vector: str, metric: Callable[[Column, Column], Column], k: int = 1, agg: str = "mean", threshold: float = 95, fit_rows: int | None = None, nearest: Callable[..., DataFrame] | None = None) -> Neighbours:
    """Inside if the mean, max or min distance to the nearest training rows is at most the
    ``threshold`` percentile of training rows' own. k+1 neighbours are taken in training, where the
    row itself is dropped, and for queries, where all count; "min" takes two. The limit comes from
    all training rows, or from ``fit_rows`` of them, those with the least hash of their id, each
    held against all, as every pair of a large training set is too much. ``nearest`` takes the place
    of ``knn_join`` where a metric has a faster search of the same results, as ``packed.tanimoto_knn``."""
    if k < 1 or agg not in ("mean", "max", "min") or not 0 <= threshold <= 100:
        raise ValueError("k must be at least 1, agg mean, max or min, threshold 0 to 100")
    used = 2 if agg == "min" else k + 1
    asked = train if fit_rows is None else train.orderBy(F.xxhash64(id_col), id_col).limit(fit_rows)
    near = _nearest(asked, train, id_col, id_col, vector, vector, metric, used, nearest).filter("rank > 1")
    own = near.groupBy("i").agg(getattr(F, {"mean": "avg"}.get(agg, agg))("distance").alias("d"))
    own = own.select(F.col("d").alias("v")).cache()  # a number a row; the percentile reads it more than once
    try:
        limit = _percentile(own, threshold / 100)
    finally:
        own.unpersist()
    return Neighbours(train, id_col, vector, metric, used, agg, float(limit), nearest)


def ensemble_spread(members: DataFrame, id_col: str, value: str, threshold: float = 1.0) -> DataFrame:
    """(id, score, inside) from one row for each member's prediction: population standard deviation."""
    out = members.groupBy(id_col).agg(F.stddev_pop(value).alias("score"))
    return out.withColumn("inside", F.col("score") <= threshold)


def prob_std(members: DataFrame, id_col: str, value: str, threshold: float = 0.1) -> DataFrame:
    """(id, score, inside): the probability mass on the other side of 0.5 of a normal with the
    members' mean and population standard deviation."""
    stats = members.groupBy(id_col).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    z = F.when(F.col("s") == 0, F.when(F.col("m") == 0.5, F.lit(0.0)).otherwise(F.lit(40.0))).otherwise(F.abs(F.try_divide(0.5 - F.col("m"), F.col("s"))))
    # Upper tail of the normal: its series up to 5, beyond it the first terms of the asymptotic one.
    density = F.exp(-z * z / 2) / F.lit(float(np.sqrt(2 * np.pi)))
    start = F.struct(z.cast("double").alias("t"), z.cast("double").alias("s"))
    step = lambda at, k: F.struct((at["t"] * z * z / (2 * k + 1)).alias("t"), (at["s"] + at["t"] * z * z / (2 * k + 1)).alias("s"))
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, step, lambda at: at["s"])
    far = density / z * (1 - 1 / (z * z) + 3 / F.pow(z, F.lit(4)) - 15 / F.pow(z, F.lit(6)))
    tail = F.when(z < 5, 0.5 - density * inner).when(z > 37, F.lit(0.0)).otherwise(far)
    return stats.select(id_col, tail.alias("score"), (tail <= threshold).alias("inside"))


def convex_hull(train: DataFrame, vector: str, most: int = 5_000, tolerance: float = 1e-6) -> Callable[[DataFrame, str, str], DataFrame]:
    """A function (df, vector, out) that tells whether a vector is a convex combination of training
    points, by Wolfe's nearest-point algorithm. The points go to executors and are bounded by ``most``."""
    rows = [r[0] for r in train.select(vector).distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"the hull takes at most {most} different points")
    points = np.array(rows, float)

    def predict(df: DataFrame, column: str, out: str = "inside") -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [nearest_in_hull(points, v) <= tolerance for v in _rows(b.column(column))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.bool_())], [*b.schema.names, out])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType())]))

    return predict


def nearest_in_hull(points: np.ndarray, query: np.ndarray, steps: int = 1000) -> float:
    """Distance from ``query`` to the hull of ``points``, each entry in units of its range, by Wolfe's
    algorithm: the corral grows by the point that lies furthest back and sheds those that the
    nearest point of its plane gives no weight."""
    width = points.max(0) - points.min(0)
    x = (points - query) / np.where(width > 0, width, 1)
    held = [int((x**2).sum(1).argmin())]
    weights, slack = np.ones(1), 1e-12 * max(1.0, float((x**2).sum(1).max()))
    at = x[held[0]]
    for _ in range(steps):
        back = x @ at
        j = int(back.argmin())
        if at @ at <= slack or back[j] >= at @ at - slack or j in held:
            break
        held.append(j)
        weights = np.append(weights, 0.0)
        while True:
            corral = x[held]
            free = np.linalg.lstsq(corral @ corral.T + 1, np.ones(len(held)), rcond=None)[0]
            free = free / free.sum()
            if (free > 1e-10).all():
                weights = free
                break
            low = free <= 1e-10
            move = float(np.min(weights[low] / np.maximum(weights[low] - free[low], 1e-300)))
            weights = (1 - move) * weights + move * free
            keep = weights > 1e-10
            held, weights = [h for h, k in zip(held, keep, strict=True) if k], weights[keep] / weights[keep].sum()
        at = weights @ x[held]
    return float(np.sqrt(at @ at))
