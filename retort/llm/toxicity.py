"""Toxicity by compression distance: windows under a toxic and an ordinary zstandard dictionary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import in_training, within
from .staging import fresh
from .words import LOW_BYTES, Words, eight_bytes, mix, pieces

NOT_LETTER = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
GRAMS = (5, 6, 7)
THRESHOLDS = (2, 3, 4, 5, 6, 7, 8, 10)
RATES = THRESHOLDS[1:]


@dataclass
class Model:
    """Both dictionaries' bytes, the window size and the calibration (means, scales, weights)."""

    ordinary: bytes
    toxic: bytes
    window: int
    level: int
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray


def windows(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, lengths and rows of windows of about ``size`` bytes: whole words, each
    window reaching over the next one's first word, so no word is cut or stands apart."""
    w = Words(texts, lower=True)
    rows = w.rows()
    if not len(rows):
        return w.bytes, np.zeros(0, np.int64), np.zeros(0, np.int64), rows
    key = (rows << 40) + (w.starts - w.offsets[rows]) // size
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.concatenate((first[1:], [len(key)])) - 1
    after = np.minimum(last + 1, len(rows) - 1)
    ends = np.minimum(np.where(rows[after] == rows[last], w.ends[after], w.ends[last]) + 1, w.offsets[rows[last] + 1])
    return w.bytes, w.starts[first], ends - w.starts[first], rows[first]


def compressor(content: bytes, size: int, level: int) -> zstandard.ZstdCompressor:
    given = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(level, source_size=size, dict_size=20_000, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=given)


def _lengths(c: zstandard.ZstdCompressor, data: bytes, segments: bytes) -> np.ndarray:
    out = c.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments), threads=1)
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


def statistics(texts: pa.Array, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor, size: int) -> np.ndarray:
    """For each row: how many bytes shorter its windows get under the toxic dictionary."""
    data, starts, lengths, rows = windows(texts, size)
    n = len(texts)
    count = np.bincount(rows, minlength=n)
    if len(starts):
        segments = np.column_stack([starts, lengths]).astype(np.uint64).tobytes()
        held = data.tobytes()
        gain = _lengths(ordinary, held, segments) - _lengths(toxic, held, segments)
    else:
        gain = np.zeros(0, np.int64)
    top = np.zeros(n)
    np.maximum.at(top, rows, gain)
    out = [top, np.bincount(rows, np.maximum(gain - 2, 0), n) / (count + 3)]
    hits = {k: np.bincount(rows, gain >= k, n) for k in THRESHOLDS}
    out += [np.log1p(hits[k]) for k in THRESHOLDS]
    out += [np.log1p(20 * hits[k] / (count + 3)) for k in RATES]
    return np.column_stack([*out, np.log1p(count)])


def _vocabulary(texts: pa.Array, rows_at_once: int = 200) -> tuple[np.ndarray, list[bytes]]:
    """Letter words and their counts of different neighbours, so copies of a passage count once."""
    contexts, owners, known = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], {}
    for lo in range(0, len(texts), rows_at_once):
        w = Words(texts.slice(lo, rows_at_once), lower=True, space=NOT_LETTER)
        h, rows = w.hash, w.rows()
        before, after = np.zeros_like(h), np.zeros_like(h)
        before[1:] = np.where(rows[1:] == rows[:-1], h[:-1], 0)
        after[:-1] = np.where(rows[1:] == rows[:-1], h[1:], 0)
        context, at = np.unique(h ^ mix(before, 21) ^ mix(after, 22), return_index=True)
        contexts.append(context)
        owners.append(h[at])
        seen, first = np.unique(h, return_index=True)
        for x, i in zip(seen.tolist(), first.tolist(), strict=True):
            if x not in known:
                known[x] = w.word(i)
    _, at = np.unique(np.concatenate(contexts), return_index=True)
    seen, counts = np.unique(np.concatenate(owners)[at], return_counts=True)
    return counts, [known[x] for x in seen.tolist()]


def _grams(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, word and count of every byte gram of `` word ``."""
    sizes = np.array([len(x) + 2 for x in words], np.int64)
    data = np.frombuffer(b"".join(b" " + x + b" " for x in words) + bytes(8), np.uint8)
    word_of, eight = np.repeat(np.arange(len(words)), sizes), eight_bytes(data)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word_of))
    hashes, owners = [], []
    for k in GRAMS:
        starts = np.flatnonzero(left >= k)
        hashes.append(mix(eight[starts] & LOW_BYTES[k], k))
        owners.append(word_of[starts])
    h, o = np.concatenate(hashes), np.concatenate(owners)
    return h, o, counts[o]


def toxic_words(toxic: pa.Array, ordinary: pa.Array, significance: float = 8.0, ratio: float = 10.0, most: int = 800) -> list[bytes]:
    """Words of the toxic texts that hold byte grams far more usual there than in ordinary texts
    (signed root of the likelihood ratio over ``significance``, rate over ``ratio`` times), rarest first."""
    ca, wa = _vocabulary(toxic)
    cb, wb = _vocabulary(ordinary)
    na, nb = max(int(ca.sum()), 1), max(int(cb.sum()), 1)
    ga, oa, na_each = _grams(wa, ca)
    gb, _, nb_each = _grams(wb, cb)
    seen, place = np.unique(ga, return_inverse=True)
    a = np.bincount(place, na_each, len(seen))
    there = np.searchsorted(seen, gb)
    there[there == len(seen)] = 0
    known = seen[there] == gb if len(seen) else np.zeros(len(gb), bool)
    b = np.bincount(there[known], nb_each[known], len(seen)) if len(seen) else np.zeros(0)
    expected = (a + b) * na / (na + nb)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (a * np.log(a / expected) + np.where(b > 0, b * np.log(b / (a + b - expected)), 0))
    good = (a >= 8) & (np.sqrt(np.maximum(g, 0)) > significance) & (a / na > ratio * b / nb)
    words = np.unique(oa[good[place]])
    chosen = sorted(words, key=lambda i: (-ca[i], wa[i]))[:most]
    return [wa[i] for i in reversed(chosen)]


def toxic_dictionary(toxic: pa.Array, ordinary: pa.Array, size: int, rows_at_once: int = 200) -> bytes:
    """A zstandard dictionary trained on every place of a toxic word in the toxic texts.

    Whole windows of toxic texts are mostly plain prose, and a dictionary of them learns that; so
    the samples are what of each window is far more usual in toxic texts (toxic_words).
    """
    words = toxic_words(toxic, ordinary)
    wanted = pa.array(words, pa.binary())
    samples: list[bytes] = []
    for lo in range(0, len(toxic), rows_at_once):
        w = Words(toxic.slice(lo, rows_at_once), lower=True, space=NOT_LETTER)
        held = pa.array([w.word(i) for i in range(len(w.starts))], pa.binary())
        samples += [b" " + x + b" " for x in held.filter(pc.is_in(held, wanted)).to_pylist()]
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:  # too few samples
        return b" ".join([b"", *words, b""])[-size:]


def fit(texts: list[str | None], y: np.ndarray, window: int = 48, level: int = 12, dictionary: int = 16_384, toxic_bytes: int = 4_096, log_odds: float = 0.0) -> Model:
    """Two thirds of the rows train the dictionaries, all calibrate the logistic score.

    The ordinary dictionary is trained on windows of ordinary texts, the toxic one on the wording
    that sets toxic texts apart (toxic_dictionary). It stands before the ordinary one, so that
    windows of plain prose get the same length under both and the difference comes from toxic
    wording. ``log_odds``: by how much the rows overstate the odds of toxic texts.
    """
    order = sorted(range(len(texts)), key=lambda i: (int(mix(np.array([len(texts[i] or "") * 2 + int(y[i])], np.uint64), 9)[0]), texts[i] or ""))
    toxic = pa.array([texts[i] or "" for k, i in enumerate(order) if y[i] == 1 and k % 3], pa.string())
    plain = pa.array([texts[i] or "" for k, i in enumerate(order) if y[i] == 0 and k % 3], pa.string())
    samples: list[bytes] = []
    each = max(1, 40_000 * 200 // max(len(plain), 1))
    for lo in range(0, len(plain), 200):
        data, starts, lengths, _ = windows(plain.slice(lo, 200), 60)
        held, step = data.tobytes(), max(1, len(starts) // each)
        samples += [held[s : s + n] for s, n in zip(starts[::step].tolist(), lengths[::step].tolist(), strict=True)]
    try:
        base = zstandard.train_dictionary(dictionary, samples).as_bytes()[-dictionary:]
    except zstandard.ZstdError:  # too few samples
        base = b" ".join(samples)[-dictionary:]
    insults = toxic_dictionary(toxic, plain, toxic_bytes)
    a, b = compressor(base, window, level), compressor(insults + base, window, level)
    x = np.concatenate([statistics(pa.array(texts[i : i + 200], pa.string()), a, b, window) for i in range(0, len(texts), 200)]) if texts else np.zeros((0, 3 + len(THRESHOLDS) + len(RATES)))
    means = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scales = (x.std(0) if len(x) else np.zeros(x.shape[1])) + 1e-6
    z = np.column_stack([(x - means) / scales, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.append(np.full(x.shape[1], 1.0), 1e-3)
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
    w[-1] -= log_odds
    return Model(base, insults + base, window, level, means, scales, w)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_toxic: int = 2_000, max_ordinary: int = 5_000, max_bytes: int = 48 << 20, **options) -> Model:
    """Fits on at most ``max_toxic`` and ``max_ordinary`` labelled training rows, by the hash of their id.

    Of these, rows after the first ``max_bytes`` of text are left out too, so the driver's memory
    is bounded. The odds of the two classes among all labelled training rows are restored in the
    calibration, so a score means the same at every size.
    """
    own = labels.filter(in_training() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_y"))
    every = {r["_y"]: r["count"] for r in own.groupBy("_y").count().collect()}  # two rows
    ranked = lambda v, most: own.filter(F.col("_y") == v).orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(most)
    chosen = ranked(1, max_toxic).unionAll(ranked(0, max_ordinary))
    texts = docs.select("doc_id", "text")
    got = within(texts, chosen, max_bytes).select("text", "_y").toArrow()
    y = got.column("_y").to_numpy().astype(float)
    used = {v: int((y == v).sum()) for v in (0, 1)}
    over = np.log(used[1] * every[0] / (used[0] * every[1])) if all(used.values()) and len(every) == 2 else 0.0
    return fit(got.column("text").to_pylist(), y, log_odds=float(over), **options)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the probability that the whole text is toxic.

    Every window of every text counts. Cases: null and empty texts have no window and score by
    the calibration alone; equal texts score alike; an empty table gives an empty table; a
    column named like the score becomes ``*_in``.
    """
    docs = fresh(docs, out)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        a, b = compressor(m.ordinary, m.window, m.level), compressor(m.toxic, m.window, m.level)
        for batch in pieces(batches):
            x = (statistics(batch.column("text"), a, b, m.window) - m.means) / m.scales
            p = 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (~in_training()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
