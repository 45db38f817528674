"""Benchmark decontamination by spaced seeds: masks that skip word positions, a join of their hashes, then verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import Staging, bitmap, in_bitmap, unused
from .words import Words, mix, pieces

#: Fixed masks over word positions; a 0 is ignored. Found by greedy search: for every passage of 8 to
#: 13 words and every choice of as many substitutions as a share of 0.8 allows, a mask at some place
#: selects none of them (a test goes through all).
MASKS = ("1111011", "110010111", "11011101", "11100111", "111111", "110101011")
#: What the masks are proven for.
WINDOW, SHARE, MIN_WORDS = 13, 0.8, 8
#: A side of so many rows at most (some 24 bytes each) is broadcast.
BROADCAST_ROWS = 1_000_000


def seeds(hashes: np.ndarray, starts: np.ndarray, number: int) -> np.ndarray:
    """Hash of the words that mask ``number`` selects from each start on."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for offset, kept in enumerate(MASKS[number]):
            if kept == "1":
                out *= np.uint64(0x9DDFEA08EB382D69)
                out += hashes[starts + offset]
    return mix(out, 200 + number)


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(_item, item_id, words, seeds): word hashes and distinct seeds of each item of ``min_words`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = Words(batch.column("text"), lower=True)
            long_enough = np.flatnonzero(w.counts >= min_words)
            words = [w.hash[w.first[i] : w.first[i + 1]] for i in long_enough]
            held = [np.unique(np.concatenate([seeds(x, np.arange(max(0, len(x) - len(m) + 1)), k) for k, m in enumerate(MASKS)])) for x in words]
            longs = lambda parts: pa.array([p.view(np.int64) for p in parts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(long_enough)) for c in ("_item", "item_id")), longs(words), longs(held)], ["_item", "item_id", "words", "seeds"])

    source = benchmark.select(F.monotonically_increasing_id().alias("_item"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:2], *T._parse_datatype_string("words array<long>, seeds array<long>").fields]))


def candidates(rows: DataFrame, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """Rows (_id, _t, _n, text) that hold a seed of both bitmaps: keys, word hashes and distinct such seeds."""
    shared = rows.sparkSession.sparkContext.broadcast((low, high))  # 2**28 bits each at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = shared.value
        for batch in pieces(batches):
            w = Words(batch.column("text"), lower=True)
            mixed = w.hash
            at, found = [], []
            for k, mask in enumerate(MASKS):
                starts = w.room(len(mask))
                h = seeds(mixed, starts, k)
                near = np.flatnonzero(in_bitmap(low, h))
                near = near[in_bitmap(high, h[near] >> np.uint64(32))]
                at.append(starts[near])
                found.append(h[near])
            row = np.searchsorted(w.first, np.concatenate(at), side="right") - 1
            found = np.concatenate(found)
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
            row, found = row[new], found[new]
            some, n = np.unique(row, return_counts=True)
            cut = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            words = pa.array([mixed[w.first[i] : w.first[i + 1]].view(np.int64) for i in some], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some)) for c in ("_id", "_t", "_n")), words, pa.ListArray.from_arrays(cut, pa.array(found.view(np.int64)))], ["_id", "_t", "_n", "words", "seeds"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:3], *T._parse_datatype_string("words array<long>, seeds array<long>").fields]))


def _diagonals(text: np.ndarray, item: np.ndarray, at_once: int = 1 << 21) -> np.ndarray:
    """All d for which a seed of the item at place p is one of the text at p + d."""
    marked = np.zeros(len(text) + len(item), bool)
    for k, mask in enumerate(MASKS):
        if len(mask) > min(len(text), len(item)):
            continue
        theirs = seeds(item, np.arange(len(item) - len(mask) + 1), k)
        place = np.argsort(theirs, kind="stable")
        theirs = theirs[place]
        mine = seeds(text, np.arange(len(text) - len(mask) + 1), k)
        lo, hi = np.searchsorted(theirs, mine), np.searchsorted(theirs, mine, side="right")
        at = np.flatnonzero(hi > lo)
        times = (hi - lo)[at]
        ends = np.cumsum(times)
        begin = 0
        while begin < len(at):  # equal words repeated in both give many pairs of places
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + at_once, side="right")))
            n = times[begin:end]
            entry = np.repeat(lo[at[begin:end]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            marked[np.repeat(at[begin:end], n) - place[entry] + len(item)] = True
            begin = end
    return np.flatnonzero(marked) - len(item)


def overlaps(text: np.ndarray, item: np.ndarray, window: int, share: float, at_once: int = 1 << 21) -> list[tuple[int, int, int]]:
    """(first word, last word, equal words) of verified overlaps of the item with the text, both as word hashes.

    A seed hit fixes a diagonal: item word p stands at text word p + d. On it, a window of
    ``window`` words (the whole item if that is shorter) must agree in ``share`` of its words or
    more; windows that meet are one overlap.
    """
    need, out = min(window, len(item)), []
    every = _diagonals(text, item)
    step = max(1, at_once // max(1, len(item)))
    for lo in range(0, len(every), step):
        d = every[lo : lo + step]
        place = d[:, None] + np.arange(len(item))
        inside = (place >= 0) & (place < len(text))
        same = inside & (text[np.clip(place, 0, len(text) - 1)] == item)
        equal = np.zeros((len(d), len(item) + 1), np.int64)
        np.cumsum(same, axis=1, out=equal[:, 1:])
        good = (equal[:, need:] - equal[:, :-need] >= share * need) & inside[:, : len(item) - need + 1] & inside[:, need - 1 :]
        for i in np.flatnonzero(good.any(1)).tolist():
            starts = np.flatnonzero(good[i])
            breaks = np.flatnonzero(np.diff(starts) > need)
            for a, b in zip(starts[np.concatenate(([0], breaks + 1))].tolist(), starts[np.concatenate((breaks, [len(starts) - 1]))].tolist(), strict=True):
                out.append((int(a + d[i]), int(b + need + d[i]), int(equal[i, b + need] - equal[i, a])))
    return out


def _verified(pairs: DataFrame, id_type: T.DataType, window: int, share: float) -> DataFrame:
    """(_id, _t, _n, item_ids, spans) of rows (_id, _t, _n, words, items) with an overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                row = whole.slice(k, 1)
                text = row.column("words").flatten().to_numpy().view(np.uint64)
                items = row.column("items").flatten()
                words, name, found, spans = items.field("words"), items.field("name"), [], []
                for j in range(len(items)):
                    got = overlaps(text, words[j].values.to_numpy().view(np.uint64), window, share)
                    if got:
                        found.append(j)
                        spans += [f"{name[j].as_py()}:{a}:{b}:{e}" for a, b, e in sorted(got)]
                if found:
                    ids = items.field("item_id").take(pa.array(found))
                    yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("_id", "_t", "_n")), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([spans], pa.list_(pa.string()))], ["_id", "_t", "_n", "item_ids", "spans"])

    schema = T.StructType([*pairs.select("_id", "_t", "_n").schema.fields, T.StructField("item_ids", T.ArrayType(id_type)), T.StructField("spans", T.ArrayType(T.StringType()))])
    return pairs.mapInArrow(run, schema)


def overlapping(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, share: float, min_words: int) -> DataFrame:
    """(_id, _t, _n, item_ids, spans) of each different row with an overlap: its id, hash and bytes of text.

    The seeds of the benchmark fill two bitmaps of bounded size; rows of text go on with the seeds
    that pass, which are joined with the benchmark's by hash. Each pair of a text and an item that
    share a seed is verified on the diagonals of all its common seeds.
    """
    if not SHARE <= share <= 1 or not MIN_WORDS <= min_words or not MIN_WORDS <= window <= WINDOW:
        raise ValueError(f"the masks are proven for a share from {SHARE} to 1, windows of {MIN_WORDS} to {WINDOW} words and items of {MIN_WORDS} or more")
    stage = Staging(docs.sparkSession)
    items = stage.put(benchmark_items(benchmark, item_col, item_text, min_words), "items")
    seed = stage.put(items.select("_item", F.explode("seeds").alias("seed")), "seeds")
    n = seed.count()
    bits = min(28, max(20, (256 * n).bit_length()))
    low, high = bitmap(seed, "seed", bits), bitmap(seed.select(F.shiftrightunsigned("seed", 32).alias("seed")), "seed", bits)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), F.octet_length(text_col).alias("_n"), F.col(text_col).alias("text"))
    found = stage.put(candidates(rows, low, high), "candidates")
    seed = F.broadcast(seed) if n <= BROADCAST_ROWS else seed
    keys = ["_id", "_t", "_n"]
    pair = found.select(*keys, F.explode("seeds").alias("seed")).join(seed, "seed").select(*keys, "_item").distinct()
    held = items.select("_item", F.struct("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "words").alias("item"))
    each = stage.put(pair.join(held, "_item").groupBy(*keys).agg(F.collect_list("item").alias("items")), "pairs")  # items that share a seed with one text
    f, e = found.dropDuplicates(keys).select(*keys, "words").alias("f"), each.alias("e")
    both = f.join(e, (F.col("f._id").eqNullSafe(F.col("e._id"))) & F.expr("f._t = e._t and f._n = e._n")).select("f.*", "e.items")
    out = stage.put(_verified(both, benchmark.schema[item_col].dataType, window, share), "verified")
    for name in ("items", "seeds", "candidates", "pairs"):
        stage.drop(name)
    return out


def _keyed(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, kept: list[str]):
    """``kept`` columns of ``docs`` as ``d``, ``found`` as ``v``, and the condition that ties them: ``v`` is broadcast only if its rows are few."""
    t, n = unused(docs, "_t"), unused(docs, "_n")
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.xxhash64(text_col).alias(t), F.octet_length(text_col).alias(n)).alias("d")
    few = found.count() <= BROADCAST_ROWS
    on = F.col(f"d.`{id_col}`").eqNullSafe(F.col("v._id")) & F.col(f"d.{t}").eqNullSafe(F.col("v._t")) & F.col(f"d.{n}").eqNullSafe(F.col("v._n"))
    return rows, (F.broadcast(found) if few else found).alias("v"), on


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of ``docs``: id, n_hits, item_ids (sorted, distinct), spans, contaminated.

    Spans are item:first:last:equal, in words of the text (last exclusive). Words are runs other
    than ASCII white space, A-Z lower-cased.

    Cases: null and empty texts, and items of fewer than ``min_words`` words, have no overlap;
    equal items are found each; repeated rows each get their own row; ids of any type, null ids
    stay null; an empty table gives an empty table, an empty benchmark finds nothing; other
    columns are ignored.
    """
    found = overlapping(docs, benchmark, id_col, text_col, item_col, item_text, window, share, min_words)
    rows, right, on = _keyed(docs, found, id_col, text_col, [id_col])
    out = rows.join(right, on, "left").select(f"d.{id_col}", "v.item_ids", "v.spans")
    ids, spans = F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType)), F.coalesce("spans", F.array().cast("array<string>"))
    return out.select(id_col, F.size(spans).cast("long").alias("n_hits"), F.array_sort(F.array_distinct(ids)).alias("item_ids"), F.array_join(F.array_sort(spans), ",").alias("spans"), (F.size(spans) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, with all their columns.

    Cases are those of ``contamination``: rows with null or empty texts stay, repeated rows stay or
    go alike, columns with clashing names are kept, an empty table gives an empty table.
    """
    found = overlapping(docs, benchmark, id_col, text_col, item_col, item_text, window, share, min_words).select("_id", "_t", "_n")
    rows, right, on = _keyed(docs, found, id_col, text_col, docs.columns)
    return rows.join(right, on, "left_anti").select(*(F.col(f"d.`{c}`") for c in docs.columns))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
