"""Group-aware, diverse and time-ordered splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .running import running_sums


def subset_sizes(total: int, train: float | int | None, valid: float | int | None, test: float | int | None) -> tuple[int, int, int]:
    """Row counts: fractions of valid and test are rounded down, train has the rest; all sizes or none."""
    given = [s for s in (train, valid, test) if s is not None]
    if not given:
        train, valid, test = 0.8, 0.1, 0.1
    elif len(given) < 3:
        raise ValueError("give all sizes or none")
    if any(s <= 0 for s in (train, valid, test)):
        raise ValueError("sizes must be positive")
    if all(isinstance(s, float) for s in (train, valid, test)):
        if abs(train + valid + test - 1) > 1e-9:
            raise ValueError("fractions must sum to 1")
        v, t = int(total * valid), int(total * test)
        return total - v - t, v, t
    if not all(isinstance(s, int) for s in (train, valid, test)) or train + valid + test != total:
        raise ValueError("counts must be whole and sum to the number of rows")
    return train, valid, test


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def group_fill_split(df: DataFrame, group: Column, order: str, valid: int, test: int, by: Column | None = None) -> DataFrame:
    """``df`` with ``subset``: whole groups go to test until it has ``test`` rows, then to valid, the rest to train.

    Groups go by size, smallest first (ties: first row), or by ``by``, a column over _group. What lies
    before a group is summed over buckets of sizes and first rows, so no task holds all groups; only
    where ``order`` is no number are groups of one size ordered in one task.
    """
    rows = df.withColumn("_group", group)
    groups = rows.groupBy("_group").agg(F.count("*").alias("_size"), F.min(order).alias("_first"))
    if by is not None:
        filled = running_sums(groups.withColumn("_by", by), [], "_by", {"_sum": F.col("_size")})
    else:
        if _numeric(df, order):
            placed = running_sums(groups, ["_size"], "_first", {"_place": F.lit(1).cast("long")})
        else:
            placed = groups.withColumn("_place", F.row_number().over(Window.partitionBy("_size").orderBy("_first")) - 1)
        starts = running_sums(groups.groupBy("_size").agg(F.sum("_size").alias("_rows")), [], "_size", {"_start": F.col("_rows")})
        filled = placed.join(starts.select(F.col("_size").alias("_s"), "_start"), F.col("_size") == F.col("_s")).withColumn("_sum", F.col("_start") + F.col("_place") * F.col("_size"))
    in_test = F.col("_sum") < test
    tested = filled.agg(F.coalesce(F.sum(F.when(in_test, F.col("_size"))), F.lit(0)).alias("_tested"))
    subset = F.when(in_test, "test").when(F.col("_sum") - F.col("_tested") < valid, "valid").otherwise("train")
    named = filled.crossJoin(F.broadcast(tested)).select(F.col("_group").alias("_g"), subset.alias("subset"))
    return rows.join(named, F.col("_group").eqNullSafe(F.col("_g"))).drop("_group", "_g")


def randomized_group_split(df: DataFrame, group: Column, order: str, valid: int, test: int, seed: int = 0) -> DataFrame:
    """group_fill_split with the groups in a seeded hash order."""
    return group_fill_split(df, group, order, valid, test, by=F.xxhash64(F.col("_group").cast("string"), F.lit(seed)))


def time_split(df: DataFrame, time: str, order: str, train: int, valid: int, not_found: str = "test") -> DataFrame:
    """``df`` with ``subset`` by time: the earliest ``train`` rows, the next ``valid``, the rest.

    Rows without a time go to ``not_found``: train, test, or removed. Counts of each time are
    summed first, and rows are numbered only within the times where a subset ends, by buckets of
    ``order`` where that is a number.
    """
    if not_found not in ("train", "test", "removed"):
        raise ValueError("not_found must be train, test or removed")
    dated = df.filter(F.col(time).isNotNull())
    counts = dated.groupBy(F.col(time).alias("_t")).agg(F.count("*").alias("_n"))
    seconds = F.col("_t").cast("timestamp").cast("double") if isinstance(df.schema[time].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col("_t").cast("double")
    starts = running_sums(counts.withColumn("_at", seconds), [], "_at", {"_start": F.col("_n")}).drop("_at")
    joined = dated.join(starts, F.col(time) == F.col("_t"))
    end = lambda edge: (F.col("_start") < edge) & (F.col("_start") + F.col("_n") > edge)
    split = end(train) | end(train + valid)  # of two times at most
    name = lambda rank: F.when(rank <= train, "train").when(rank <= train + valid, "valid").otherwise("test")
    whole = joined.filter(~split).withColumn("subset", name(F.col("_start") + F.col("_n")))
    cut = joined.filter(split)
    if _numeric(df, order):
        cut = running_sums(cut, ["_t"], order, {"_place": F.lit(1).cast("long")})
    else:
        cut = cut.withColumn("_place", F.row_number().over(Window.partitionBy("_t").orderBy(order)) - 1)
    out = whole.unionByName(cut.withColumn("subset", name(F.col("_start") + F.col("_place") + 1)).drop("_place")).drop("_t", "_n", "_start")
    if not_found == "removed":
        return out
    return out.unionByName(df.filter(F.col(time).isNull()).withColumn("subset", F.lit(not_found)))


def _tanimoto_to(words: np.ndarray, one: np.ndarray) -> np.ndarray:
    both = np.bitwise_count(words & one).sum(1, dtype=np.int64)
    union = np.bitwise_count(words | one).sum(1, dtype=np.int64)
    return np.where(union == 0, 0.0, 1 - both / np.maximum(union, 1))


def maxmin_pick(words: np.ndarray, picks: int, start: int | None = None, seed: int = 0) -> list[int]:
    """Greedy diverse rows of packed bits: each pick is farthest from all picks before it (ties: lowest row)."""
    chosen = [int(np.random.default_rng(seed).integers(len(words))) if start is None else start]
    nearest = _tanimoto_to(words, words[chosen[0]])
    while len(chosen) < min(picks, len(words)):
        nearest[chosen] = -1
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, _tanimoto_to(words, words[chosen[-1]]))
    return chosen[:picks]


def leaders(words: np.ndarray, threshold: float) -> np.ndarray:
    """Rows that lead a cluster: each row farther than ``threshold`` from every leader before it."""
    chosen: list[int] = []
    free = np.ones(len(words), bool)
    while free.any():
        c = int(np.argmax(free))
        chosen.append(c)
        free &= _tanimoto_to(words, words[c]) > threshold
    return np.array(chosen, np.int64)


def _collected(df: DataFrame, id_col: str, bits: str, most: int) -> tuple[list, np.ndarray]:
    rows = df.select(id_col, bits).orderBy(id_col).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a sequential pick takes at most {most} rows; sample or cluster first")
    return [r[0] for r in rows], np.array([[w & (2**64 - 1) for w in r[1]] for r in rows], np.uint64)


def _first(ids: list, start) -> int | None:
    """The place of the id to start from."""
    if start is None:
        return None
    if start not in ids:
        raise ValueError(f"no row has the id {start}")
    return ids.index(start)


def maxmin_split(df: DataFrame, id_col: str, bits: str, test: int, valid: int = 0, seed: int = 0, most: int = 200_000, start=None) -> DataFrame:
    """``df`` with ``subset``: MaxMin picks are test, further picks are valid, from the row with the
    id ``start`` on, else from a seeded one. The greedy pick is sequential, so the packed bits (not
    the rows) of at most ``most`` rows come to the driver."""
    ids, words = _collected(df, id_col, bits, most)
    return _named(df, id_col, _picked(ids, words, test, valid, seed, _first(ids, start)))


def _picked(ids: list, words: np.ndarray, test: int, valid: int, seed: int, first: int | None) -> dict:
    order = maxmin_pick(words, test + valid, start=first, seed=seed) if test + valid and ids else []
    return {ids[i]: "test" if k < test else "valid" for k, i in enumerate(order)}


def _named(df: DataFrame, id_col: str, names: dict) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    table = df.sparkSession.createDataFrame(list(names.items()), f"_i {kind}, subset string")
    out = df.join(F.broadcast(table), F.col(id_col) == F.col("_i"), "left").drop("_i")  # at most the driver's bound of rows
    return out.withColumn("subset", F.coalesce("subset", F.lit("train")))


def stratified_maxmin_split(df: DataFrame, id_col: str, bits: str, label: str, test_share: float = 0.2, valid_share: float = 0.0, seed: int = 0, most: int = 200_000, from_least: bool = False) -> DataFrame:
    """MaxMin within each label; every label gives its shares of rows, one row at least, to test and
    to valid. Picks start at the least id of a label (``from_least``) or at a seeded row. All labels
    come in one job, ``most`` rows together."""
    if min(test_share, valid_share) < 0 or test_share + valid_share >= 1:
        raise ValueError("shares must not be negative and sum to less than 1")
    rows = df.select(id_col, bits, label).orderBy(id_col).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a sequential pick takes at most {most} rows; sample or cluster first")
    parts: dict = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    names: dict = {}
    for part in parts.values():
        words = np.array([[w & (2**64 - 1) for w in r[1]] for r in part], np.uint64)
        size = lambda share, n=len(part): max(1, int(n * share)) if share else 0
        names |= _picked([r[0] for r in part], words, size(test_share), size(valid_share), seed, 0 if from_least else None)
    return _named(df, id_col, names)


def _words(column: pa.Array) -> np.ndarray:
    """Packed vectors of a list column as a matrix."""
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)


def butina_clusters(df: DataFrame, id_col: str, bits: str, threshold: float = 0.65, block: int = 20_000, most: int = 200_000) -> DataFrame:
    """``df`` with ``cluster``: the id of the nearest leader (ties: the first leader).

    A leader is farther than ``threshold`` from every leader before it, in the order of ids. Blocks
    of rows that no leader covers yet come to the driver, which picks among them; the executors
    then drop what the new leaders cover. Only leaders are kept there and sent around, ``most`` of
    them, so the rows may be as many as they like.
    """
    rows, found = df.select(F.col(id_col).alias("_i"), F.col(bits).alias("_v")), []
    context = df.sparkSession.sparkContext
    while True:
        sent = context.broadcast(np.array([w for _, w in found], np.uint64))  # at most ``most`` vectors

        def free(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words, left = _words(b.column(1)), np.ones(b.num_rows, bool)
                for one in sent.value:
                    left &= _tanimoto_to(words, one) > threshold
                yield b.filter(pa.array(left))

        now = (rows.mapInArrow(free, rows.schema) if found else rows).orderBy("_i").limit(block).collect()
        if not now:
            break
        words = np.array([[w & (2**64 - 1) for w in r[1]] for r in now], np.uint64)
        found += [(now[i][0], words[i]) for i in leaders(words, threshold).tolist()]
        if len(found) > most:
            raise ValueError(f"more than {most} clusters; raise the threshold")
        if len(now) < block:
            break
    held = context.broadcast(np.array([w for _, w in found], np.uint64))
    names = pa.array([i for i, _ in found])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _words(b.column(b.schema.get_field_index(bits)))
            best, cluster = np.full(b.num_rows, np.inf), np.zeros(b.num_rows, np.int64)
            for k, one in enumerate(held.value):
                d = _tanimoto_to(words, one)
                cluster = np.where(d < best, k, cluster)
                best = np.minimum(best, d)
            yield pa.RecordBatch.from_arrays([*b.columns, names.take(pa.array(cluster)).cast(b.column(b.schema.get_field_index(id_col)).type)], [*b.schema.names, "cluster"])

    return df.mapInArrow(nearest, T.StructType([*df.schema.fields, T.StructField("cluster", df.schema[id_col].dataType)]))


def butina_split(df: DataFrame, id_col: str, bits: str, valid: int, test: int, threshold: float = 0.65) -> DataFrame:
    return group_fill_split(butina_clusters(df, id_col, bits, threshold), F.col("cluster"), id_col, valid, test)
