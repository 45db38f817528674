"""Running sums and exact percentiles without one task for a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Up to so many rows one window does, as a task can sort them all.
ONE_WINDOW = 200_000


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], descending: bool = False, buckets: int = 64) -> DataFrame:
    """``df`` with each of ``sums`` added up over the rows before, by a number column ``order`` within ``keys``.

    Few rows take a plain window. Beyond ONE_WINDOW approximate quantiles cut each key into buckets of values, so equal values share one; a bucket is
    summed by itself and starts where the buckets before it end. Rows equal in ``order`` count each
    other in an unspecified order: give rows of different values, or sum them up before.
    """
    if df.limit(ONE_WINDOW + 1).count() <= ONE_WINDOW:
        plain = Window.partitionBy(*keys).orderBy(F.col(order).desc() if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(plain), F.lit(0)) for n, c in sums.items()})
    value = F.col(order).cast("double")
    marks = F.percentile_approx(value, [k / buckets for k in range(1, buckets)], 1000).alias("_marks")
    bounds = (df.groupBy(*keys).agg(marks) if keys else df.agg(marks)).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    met = df.join(bounds, on) if keys else df.crossJoin(F.broadcast(bounds))  # without keys one row
    place = F.size(F.filter("_marks", lambda m: m < value))
    dealt = met.withColumn("_bucket", (-place if descending else place)).drop("_marks", *(f"_k{i}" for i in range(len(keys))))
    sort = F.col(order).desc() if descending else F.col(order)
    own = Window.partitionBy(*keys, "_bucket").orderBy(sort).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_l_{n}": F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    totals = dealt.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])  # at most ``buckets`` rows a key
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    out = local.join(starts, [*on, F.col("_bucket") == F.col("_b")])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_l_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums])


def exact_percentiles(long: DataFrame, key: str, value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """(key, p0, p1 ...): percentiles by linear interpolation, one for each of ``shares`` (0 to 1).

    An approximate percentile brackets each; only what lies between the brackets (some 4 / accuracy
    of the rows, and few ones more) is sorted, the rest is counted.
    """
    fewest = long.groupBy(key).agg(F.count(value).alias("n")).agg(F.min("n")).first()[0] or 1
    reach = 2 / accuracy + 2 / max(fewest, 1)
    marks = [F.percentile_approx(value, [max(0.0, p - reach), min(1.0, p + reach)], accuracy).alias(f"_m{k}") for k, p in enumerate(shares)]
    stats = long.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count(value).alias("_n"), *marks)
    joined = long.filter(F.col(value).isNotNull()).join(stats.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")))
    parts = []
    for k in range(len(shares)):
        low, high = F.get(f"_m{k}", F.lit(0)), F.get(f"_m{k}", F.lit(1))
        parts += [F.sum((F.col(value) < low).cast("long")).alias(f"_b{k}"), F.sort_array(F.collect_list(F.when((F.col(value) >= low) & (F.col(value) <= high), F.col(value)))).alias(f"_v{k}")]
    got = joined.groupBy(key).agg(F.first("_n").alias("_n"), *parts)
    out = []
    for k, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("_n") - 1) - F.col(f"_b{k}")
        floor = F.floor(at + 1e-9).cast("int")
        first, second = F.get(f"_v{k}", floor), F.get(f"_v{k}", floor + 1)
        part = F.greatest(at - floor, F.lit(0.0))
        out.append(F.when(second.isNull(), first).otherwise(first + part * (second - first)).alias(f"p{k}"))
    return got.select(key, *out)
