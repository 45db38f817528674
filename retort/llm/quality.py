"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import fresh
from .words import Words, mix, pieces

WORD_SLOTS = 1 << 15
BUCKETS = 24
#: Character classes counted per text: upper case, digits, symbols, sentence marks, bytes beyond ASCII.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*<>=@[]^_`{|}~+/\\", b".,;:!?", bytes(range(128, 256)))
STATS = len(CLASSES) + 7


def _ratios(w: Words, raw: np.ndarray, keys: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """STATS numbers from 0 to 1 for each row; a text without words has 0 throughout."""
    n = len(w.counts)
    size = np.maximum(np.diff(w.offsets), 1)
    words = np.maximum(w.counts, 1)
    out = []
    for members in CLASSES:
        table = np.zeros(256, dtype=bool)
        table[list(members)] = True
        total = np.concatenate(([0], np.cumsum(table[raw], dtype=np.int64)))
        out.append(np.diff(total[w.offsets]) / size)
    distinct = np.bincount(rows, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, rows, counts)
    same = np.zeros(len(w.hash), dtype=bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    heads = w.first[:-1][w.counts > 0]
    same[heads] = False
    at = w.rows()
    lengths = np.minimum((w.ends - w.starts) / 16.0, 1)
    out += [distinct / words, top / words, np.bincount(at, same, n) / words, np.bincount(at, lengths, n) / words]
    out += [np.minimum(np.log2(1 + w.counts) / 20, 1), np.minimum(np.log2(1 + np.diff(w.offsets)) / 24, 1)]
    return np.column_stack(out)


def features(texts: pa.Array, metadata: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, feature numbers and values of a batch, by row. Each structure statistic and each
    metadata number is one of BUCKETS indicators; words weigh the root of their share."""
    w = Words(texts, lower=True)
    raw = Words(texts).bytes
    n = len(texts)
    key = mix(w.hash, 11) % np.uint64(WORD_SLOTS) + w.rows().astype(np.uint64) * np.uint64(WORD_SLOTS)
    keys, counts = np.unique(key, return_counts=True)
    rows = (keys // np.uint64(WORD_SLOTS)).astype(np.int64)
    slot = (keys % np.uint64(WORD_SLOTS)).astype(np.int64)
    value = np.sqrt(counts / np.maximum(w.counts, 1)[rows])
    stats = _ratios(w, raw, keys, counts, rows)
    stats = np.column_stack([stats, (rows_mean(rows, counts, n) / 32).clip(0, 1)])
    for column in metadata:
        given = np.asarray(column.cast(pa.float64()).fill_null(float("nan")))
        stats = np.column_stack([stats, np.where(np.isfinite(given), np.minimum(np.log2(1 + np.maximum(given, 0)) / 24, 1), 1.0)])
    bucket = np.minimum(np.sqrt(stats) * (BUCKETS - 1), BUCKETS - 1).astype(np.int64)
    number = WORD_SLOTS + np.arange(stats.shape[1]) * BUCKETS + bucket
    rows = np.concatenate([rows, np.repeat(np.arange(n), stats.shape[1])])
    slot = np.concatenate([slot, number.ravel()])
    value = np.concatenate([value, np.full(number.size, 0.3)])
    order = np.argsort(rows, kind="stable")
    return rows[order], slot[order], value[order].astype(np.float32)


def rows_mean(rows: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, counts, n) / np.maximum(np.bincount(rows, minlength=n), 1)


class Machine:
    """w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2], in linear time."""

    def __init__(self, size: int, rank: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = rng.normal(0, 0.05, (size, rank))

    def raw(self, rows, slot, value, n):
        out = self.w0 + np.bincount(rows, self.w[slot] * value, n)
        for f in range(self.v.shape[1]):
            t = self.v[slot, f] * value
            out += 0.5 * (np.bincount(rows, t, n) ** 2 - np.bincount(rows, t * t, n))
        return out

    def score(self, rows, slot, value, n):
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, slot, value, n), -30, 30)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 5, batch: int = 256, rate: float = 0.1, decay: float = 1e-5, seed: int = 3) -> Machine:
        """Adagrad on logistic loss; both classes weigh by the root of their rarity."""
        rng = np.random.default_rng(seed)
        rare = np.where(y == 1, max(y.mean(), 1e-6), max(1 - y.mean(), 1e-6))
        weight = 1 / np.sqrt(rare)
        weight /= weight.mean()
        g0, gw, gv = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                rows = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
                slot = np.concatenate([docs[i][0] for i in part])
                value = np.concatenate([docs[i][1] for i in part]).astype(float)
                vx = self.v[slot] * value[:, None]
                sums = np.stack([np.bincount(rows, vx[:, f], len(part)) for f in range(vx.shape[1])], 1)
                out = self.w0 + np.bincount(rows, self.w[slot] * value, len(part)) + 0.5 * ((sums**2).sum(1) - np.bincount(rows, (vx**2).sum(1), len(part)))
                error = weight[part] * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part]) / len(part)
                e = error[rows] * value
                seen, place = np.unique(slot, return_inverse=True)
                dw = np.bincount(place, e, len(seen)) + decay * self.w[seen]
                each = e[:, None] * (sums[rows] - vx)
                dv = np.stack([np.bincount(place, each[:, f], len(seen)) for f in range(each.shape[1])], 1) + decay * self.v[seen]
                g0 += error.sum() ** 2
                self.w0 -= rate * error.sum() / np.sqrt(g0)
                gw[seen] += dw**2
                self.w[seen] -= rate * dw / np.sqrt(gw[seen])
                gv[seen] += dv**2
                self.v[seen] -= rate * 0.3 * dv / np.sqrt(gv[seen])
        return self


def in_training(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) mod 5 is not 0; the others are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def within(docs: DataFrame, chosen: DataFrame, max_bytes: int) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ...) whose id is ``chosen`` (bounded by its caller), as far as
    their texts in the order of a hash of the id come to ``max_bytes``."""
    both = docs.join(F.broadcast(chosen), "doc_id")
    sizes = both.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("doc_id", F.lit(6)).alias("h")).toArrow().sort_by([("h", "ascending"), ("n", "ascending")])
    total = np.cumsum(sizes.column("n").to_numpy())
    if not len(total) or total[-1] <= max_bytes:
        return both
    limit = sizes.column("h").to_numpy()[int(np.searchsorted(total, max_bytes, side="right"))]
    return both.filter(F.xxhash64("doc_id", F.lit(6)) < F.lit(int(limit)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: tuple[str, ...] | None = None, max_rows: int = 20_000, max_bytes: int = 48 << 20, **fit) -> Machine:
    """Fits on at most ``max_rows`` labelled training rows and ``max_bytes`` of their text (the smallest hashes of their ids)."""
    metadata = _metadata(docs, metadata)
    chosen = labels.filter(in_training() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "_y").limit(max_rows)
    rows = within(docs.select("doc_id", "text", *metadata), chosen, max_bytes)
    size = WORD_SLOTS + (STATS + 8 + len(metadata)) * BUCKETS

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            r, slot, value = features(batch.column("text"), [batch.column(m) for m in metadata])
            cut = np.searchsorted(r, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.ListArray.from_arrays(cut, pa.array(slot.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(value))], ["y", "slot", "value"])

    got = rows.mapInArrow(extract, "y int, slot array<int>, value array<float>").toArrow()
    machine = Machine(size)
    if not got.num_rows:
        return machine
    y = got.column("y").to_numpy().astype(float)
    docs_ = list(zip((x.values.to_numpy() for x in _each(got.column("slot"))), (x.values.to_numpy() for x in _each(got.column("value"))), strict=True))
    order = sorted(range(len(docs_)), key=lambda i: (y[i], docs_[i][0].tobytes(), docs_[i][1].tobytes()))  # the rows' order must not matter
    return machine.fit([docs_[i] for i in order], y[order], **fit)


def _each(column: pa.ChunkedArray):
    for chunk in column.chunks:
        for i in range(len(chunk)):
            yield chunk[i]


def _metadata(docs: DataFrame, named: tuple[str, ...] | None) -> tuple[str, ...]:
    """The metadata columns: those named, else n_chars where ``docs`` has it."""
    return named if named is not None else tuple(c for c in ("n_chars",) if c in docs.columns)


def score(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] | None = None, out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of the whole text.

    Cases: a null text scores like an empty one, from structure and metadata alone; null
    metadata has a bucket of its own; an untrained machine scores 0.5; equal rows score
    alike; an empty table gives an empty table; a column of that name becomes ``*_in``.
    """
    metadata = _metadata(docs, metadata)
    docs = fresh(docs, out)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32)))  # WORD_SLOTS * (rank + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.__new__(Machine)
        m.w0, m.w, m.v = shared.value
        for batch in pieces(batches):
            got = m.score(*features(batch.column("text"), [batch.column(x) for x in metadata]), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (~in_training()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
