"""Repeated word passages by compaction of a token De Bruijn graph."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import Staging, bitmap, bits_for, in_bitmap
from .words import Words, mix, pieces, runs

MOST = np.iinfo(np.uint64).max
#: A path with over this share of all occurrences is hot; there are fewer than HOT of them.
HOT = 1000
_BLANKS = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))


def paths(w: Words, k: int, m: int, with_edges: bool = True) -> tuple[np.ndarray, ...]:
    """Edges (k-word windows) of all rows as paths: runs of edges with one minimizer.

    The minimizer is the leftmost least hash among a window's m-word runs. Equal windows have
    equal minimizers at equal places, so a path holds no edge twice and equal passages give
    equal paths inside, whatever surrounds them. Returns first word, number of edges, row and
    minimizer of each path, and the hashes of all edges by their first word; edges and
    minimizers come from two independent hashes of the words.
    """
    n, span = len(w.starts), k - m + 1
    at, hashes = w.windows(m, salt=1)
    value, place = np.full(n + span, MOST, np.uint64), np.arange(n + span)
    value[at] = hashes
    done = 1
    while done < span:  # least of 1, 2, 4 ... runs from each place on
        step = min(done, span - done)
        less = value[step:] < value[:-step]
        value = np.concatenate((np.where(less, value[step:], value[:-step]), value[-step:]))
        place = np.concatenate((np.where(less, place[step:], place[:-step]), place[-step:]))
        done += step
    starts = w.room(k)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rows, where = w.rows()[starts], place[starts]
    first = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (rows[1:] != rows[:-1]))))
    count = np.diff(np.concatenate((first, [len(starts)])))
    every = runs(mix(w.other_hash(), 3), k) if with_edges else np.zeros(0, np.uint64)
    return starts[first], count, rows[first], value[starts[first]], every


def digests(w: Words, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """BLAKE2 digests of runs of words as they stand, joined by single spaces."""
    held = w.bytes.tobytes().translate(_BLANKS)
    wide = np.zeros(len(w.starts) + 1, np.int64)  # gaps of more than one byte before each word
    np.cumsum(w.starts[1:] > w.ends[:-1] + 1, out=wide[1:-1])
    wide[-1] = wide[-2] if len(wide) > 1 else 0
    last = start + words - 1
    plain = wide[last] == wide[start]
    out = bytearray()
    for a, b, single in zip(w.starts[start].tolist(), w.ends[last].tolist(), plain.tolist(), strict=True):
        run = held[a:b]
        out += hashlib.blake2b(run if single else b" ".join(run.split()), digest_size=8).digest()
    return np.frombuffer(bytes(out), np.int64)


def _ids(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    take = pa.array(rows)
    return [batch.column("_id").take(take), batch.column("_t").take(take)]


def repeated_windows(docs: DataFrame, stage: Staging, k: int, m: int) -> DataFrame:
    """(_id, _t, spans): for each text that repeats something, its windows that also start
    earlier, as structs (start, mask): bit i stands for the window at word start + i.

    ``docs`` has _id, _t (a hash of the text) and text. First the minimizers are counted. Paths
    whose minimizer is repeated (by a bitmap of bounded size, which may let others pass) are
    written with their edges; paths compact to one with its first source if the minimizer and a
    BLAKE2 digest of the very words agree; edges of the compacted paths meet on (minimizer, edge), two
    independent 64-bit hashes of the words, and the least source of each wins; joins carry what
    is not first back to the paths and their sources. The few hot paths are joined by broadcast.
    """

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            seen, n = np.unique(paths(Words(batch.column("text")), k, m, False)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["mini", "n"])

    counted = docs.select("text").mapInArrow(minimizers, "mini long, n int").groupBy("mini").agg(F.sum("n").alias("n")).filter("n > 1").select("mini")
    counted = stage.put(counted, "minimizers")
    table = docs.sparkSession.sparkContext.broadcast(bitmap(counted, "mini", bits_for(counted)))  # 2**28 bits at most

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = Words(batch.column("text"))
            start, count, row, mini, edges = paths(w, k, m)
            some = in_bitmap(table.value, mini)
            start, count, row, mini = start[some], count[some], row[some], mini[some]
            cut = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            inside = np.repeat(start - cut[:-1], count) + np.arange(cut[-1])
            held = edges[inside]
            own = digests(w, start, count + k - 1)
            columns = [*_ids(batch, row), pa.array((start - w.first[row]).astype(np.int32)), pa.array(mini.view(np.int64)), pa.array(own), pa.ListArray.from_arrays(cut, pa.array(held.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_t", "start", "mini", "path", "edges"])

    found = T.StructType([docs.schema["_id"], docs.schema["_t"], *T._parse_datatype_string("start int, mini long, path long, edges array<long>").fields])
    record = stage.put(docs.select("_id", "_t", "text").mapInArrow(records, found), "records")
    stage.sweep()
    path = record.groupBy("mini", "path").agg(F.min(F.struct("_id", "start")).alias("source"), F.min("edges").alias("edges"), F.count("*").alias("times"))
    path = stage.put(path, "paths")
    stage.sweep()
    record = stage.put(record.select("_id", "_t", "start", "mini", "path", F.size("edges").alias("n")), "occurrences")
    stage.drop("records")
    several = path.groupBy("mini").agg(F.count("*").alias("n")).filter("n > 1").select("mini")  # else no edge is in two paths
    edge = path.join(several, "mini").select("mini", "path", "source", F.posexplode("edges").alias("i", "edge"))
    edge = edge.select("mini", "path", "edge", "i", F.col("source._id").alias("_id"), (F.col("source.start") + F.col("i")).alias("at"))
    least = edge.groupBy("mini", "edge").agg(F.min(F.struct("_id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = edge.join(least, ["mini", "edge"]).filter(~(F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("at") == F.col("first.at"))))
    own = ["mini", "path"]
    masks = stage.put(later.groupBy(*own).agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask")), "masks")
    stage.sweep()
    judged = path.select(*own, "source", "times").join(masks, own, "left")
    judged = stage.put(judged.select(*own, "times", F.col("source._id").alias("s_id"), F.col("source.start").alias("s_start"), F.coalesce("mask", F.lit(0).cast("long")).alias("mask")), "judged")
    for name in ("paths", "masks"):
        stage.drop(name)
    stage.sweep()
    total = judged.agg(F.sum("times")).first()[0] or 0
    hot = judged.filter(F.col("times") > max(total / HOT, HOT)).drop("times")  # fewer than HOT rows
    cold = record.join(F.broadcast(hot.select(*own)), own, "left_anti").join(judged.drop("times"), own)
    back = record.join(F.broadcast(hot), own).unionByName(cold)
    is_source = F.col("_id").eqNullSafe(F.col("s_id")) & (F.col("start") == F.col("s_start"))
    back = back.select("_id", "_t", "start", F.when(is_source, F.col("mask")).otherwise(F.expr("shiftleft(1L, n) - 1")).alias("mask")).filter("mask <> 0")
    return back.groupBy("_id", "_t").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))  # no longer than the text


def covered(n_words: int, start: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """True for each word that a window of the spans (start, mask) covers."""
    span, bit = np.nonzero((mask[:, None] >> np.arange(63)) & 1)
    at = start[span].astype(np.int64) + bit
    change = np.bincount(at, minlength=n_words + k + 1) - np.bincount(at + k, minlength=n_words + k + 1)
    return np.cumsum(change)[:n_words] > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 6, with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_removed, kept_sha256 (and kept_text).

    A word goes if a window of ``k`` words that covers it also starts earlier: in a document
    with a smaller id, or before in its own. Windows are judged on the input. The kept words
    are joined by single spaces.

    Cases: null and empty texts and those under k words lose nothing; rows with one id and one
    text are one document and keep alike; of texts with one id a window counts by its place; a
    null id comes before all others; an empty table gives an empty table; other columns are ignored.
    """
    if not 2 <= m < k or k - m + 1 > 62:
        raise ValueError("m must be at least 2 and less than k, and k - m at most 61")
    stage = Staging(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("text"))
    spans = stage.put(repeated_windows(source, stage, k, m), "spans")
    for name in ("minimizers", "occurrences", "judged"):
        stage.drop(name)
    stage.sweep()
    s, g = source.alias("s"), spans.alias("g")
    rows = s.join(g, F.col("s._id").eqNullSafe(F.col("g._id")) & (F.col("s._t") == F.col("g._t")), "left").select("s._id", "s.text", "g.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words, gone, sha, kept_text = [], [], [], []
            spans = batch.column("spans")
            start, mask = (spans.values.field(i).to_numpy() for i in (0, 1))
            cut, has = spans.offsets.to_numpy(), spans.is_valid().to_numpy(zero_copy_only=False)
            for i, text in enumerate(batch.column("text").to_pylist()):
                held = (text or "").encode().split()
                words.append(len(held))
                if has[i]:
                    part = slice(cut[i], cut[i + 1])
                    kept = list(compress(held, (~covered(len(held), start[part], mask[part], k)).tolist()))
                else:
                    kept = held
                gone.append(len(held) - len(kept))
                joined = b" ".join(kept)
                sha.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept_text.append(joined.decode())
            columns = [batch.column("_id"), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept_text, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if with_text:
        schema = schema.add("kept_text", "string")
    return rows.mapInArrow(run, schema)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=20)


#: Every window by its words, the first place of each, and the words that later ones cover.
OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
a AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS s FROM w WHERE len(w) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM a), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE k > 1),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w), k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i WHERE c.i IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
