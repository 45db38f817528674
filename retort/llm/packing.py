"""Packing token sequences as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..memo import Memo
from .staging import Staging, numbered
from .words import pieces

WIDTH = 8  # tokens in a unit of length


#: Fixed values of byte-level BPE files: the pattern of pieces, and the bytes that stand for themselves.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ITSELF = (*range(33, 127), *range(161, 173), *range(174, 256))


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids by the bytes of each token, if the file is plain byte-level BPE whose ids follow its merges; else None."""
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
    if not plain or any(odd) or spec.get("normalizer") is not None:
        return None
    others = [b for b in range(256) if b not in ITSELF]
    byte_of = {chr(b): b for b in ITSELF} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary = model["vocab"]
    made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if min(made, default=0) < 0 or made != sorted(set(made)):
        return None
    added = {t["content"] for t in spec.get("added_tokens") or []}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in added and all(c in byte_of for c in t)}
    return ranks if len(made) + 256 == len(ranks) else None


class Encoder:
    """Little-endian uint32 ids of whole texts by a tokenizer file, without added special tokens.

    Plain byte-level BPE goes through a faster encoder of the same ids; other files, and texts
    that hold an added token, through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = byte_ranks(spec)
        self.fast = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(added)) if added else None

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or (self.added and self.added.search(text)):
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path)
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_ENCODERS = Memo(1)


def encoder(path: str) -> Encoder:
    """One for each task: the vocabulary only."""
    return _ENCODERS.get(path, Encoder)


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens (and ids).

    A document is its ids and ``end_id``; it is cut only into whole sequences and one remainder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in pieces(batches, text_col):
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(text_col)):
                held = own.ids(text.as_py()) + end
                for at in range(0, len(held), 4 * capacity):
                    part = held[at : at + 4 * capacity]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(held) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(id_col).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def priced_patterns(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray]]:
    """Unbounded knapsack by dynamic programming over the capacity: for each size the dearest
    pattern that holds it, dearest first (the first is the best pattern of all)."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    small, dear = sizes[order], worth[order]
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(small, c, side="right"))
        value[c] = value[c - 1]
        if n:
            offer = value[c - small[:n]] + dear[:n]
            k = int(offer.argmax())
            if offer[k] > value[c] + 1e-12:
                value[c], last[c] = offer[k], order[k]
    total = value[capacity - sizes] + worth
    out, seen = [], set()
    for k in np.argsort(-total, kind="stable").tolist():
        pattern = np.zeros(len(sizes), np.int64)
        pattern[k], c = 1, capacity - int(sizes[k])
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                pattern[last[c]] += 1
                c -= int(sizes[last[c]])
        if pattern.tobytes() not in seen:
            seen.add(pattern.tobytes())
            out.append((float(total[k]), pattern))
    return out


def inverted(a: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan steps on whole rows; threads of a BLAS would only wait for each other here."""
    n = len(a)
    both = np.concatenate([a, np.eye(n)], axis=1)
    for i in range(n):
        k = i + int(np.abs(both[i:, i]).argmax())
        both[[i, k]] = both[[k, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        rows = np.flatnonzero(factor)
        both[rows] -= np.outer(factor[rows], both[i])
    return both[:, n:]


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used (reals), by simplex with priced columns.

    The basis starts with one size a pattern; the knapsack prices columns with the duals, each
    that still improves enters, and pricing stops when none is worth more than a bin or the
    dual bound is within ``gap``.
    """
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    x = demand / np.diag(basis)
    bound, center, pull = 0.0, np.asarray(sizes / capacity), 0.8
    dual = inverse.sum(0)
    for step in range(rounds):
        if x.sum() - bound <= gap * x.sum():
            break
        priced = pull * center + (1 - pull) * dual  # duals swing; prices stay near those of the best bound
        columns = priced_patterns(sizes, priced, capacity)
        reach = float((priced * demand).sum()) / columns[0][0]
        if reach > bound:
            bound, center = reach, priced / columns[0][0]
        entered = 0
        for _, column in columns:
            used = np.flatnonzero(column)
            gain = float((dual[used] * column[used]).sum()) - 1
            if gain <= 1e-9:
                continue
            entered += 1
            move = (inverse[:, used] * column[used]).sum(1)
            ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
            out = int(np.argmin(ratio))
            x = np.maximum(x - ratio[out] * move, 0)
            x[out] = ratio[out]
            basis[:, out] = column
            pivot = inverse[out] / move[out]
            dual = dual - gain * pivot
            inverse -= np.outer(move, pivot)
            inverse[out] = pivot
        if step % 20 == 19:
            inverse = inverted(basis)  # against rounding errors
            x, dual = np.maximum((inverse * demand).sum(1), 0), inverse.sum(0)
        if not entered and pull == 0:
            break
        pull = 0.8 if entered else 0.0
    x = np.maximum((inverted(basis) * demand).sum(1), 0)
    return basis.T.astype(np.int64), x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: pieces}) for whole bins that hold exactly the histogram's pieces.

    The LP's solution is rounded down; what is left goes into bins filled largest first.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    out: list[tuple[int, dict[int, int]]] = []
    if left:
        sizes = np.array(sorted(left), np.int64)
        patterns, times = cutting_stock(sizes, np.array([left[s] for s in sizes.tolist()], float), capacity)
        for pattern, n in zip(patterns, np.floor(times + 1e-7).astype(np.int64).tolist(), strict=True):
            use = {int(s): int(k) for s, k in zip(sizes, pattern, strict=True) if k}
            n = min([n, *(left[s] // k for s, k in use.items())])
            if n > 0:
                out.append((n, use))
                for s, k in use.items():
                    left[s] -= n * k
    while any(left.values()):
        use = fullest({s: n for s, n in left.items() if n}, capacity)
        n = min(left[s] // k for s, k in use.items())
        out.append((n, use))
        for s, k in use.items():
            left[s] -= n * k
    return out


def fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The largest size with what fills the rest of a bin best, larger sizes first (bounded subset sum)."""
    sizes = sorted(left, reverse=True)
    by = np.full(capacity + 1, -1)  # the size that was added last to reach a sum
    reached = np.zeros(capacity + 1, bool)
    reached[sizes[0]] = True
    by[sizes[0]] = sizes[0]
    for s in sizes:
        for _ in range(min(left[s] - (s == sizes[0]), capacity // s)):
            new = np.zeros_like(reached)
            new[s:] = reached[:-s]
            new &= ~reached & ((by == -1) | (by == s))
            if not new.any():
                break
            by[new] = s
            reached |= new
        if reached[capacity]:
            break
    use: dict[int, int] = {}
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        use[int(by[at])] = use.get(int(by[at]), 0) + 1
        at -= int(by[at])
    return use


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with sequence_id and offset, at most ``capacity`` ids a sequence.

    Lengths fall in classes of WIDTH tokens; the histogram of classes (at most capacity / WIDTH
    numbers) goes to the driver, which solves the cutting-stock problem. Documents are ranked
    within their class without one task a class, and a rank decides the sequence by arithmetic
    over a table of intervals whose size follows the number of patterns, not of documents.

    Cases: a null text is empty and has the end id only; rows with one id are packed each for
    itself; an empty table gives an empty table; other columns are ignored.
    """
    if capacity % WIDTH or capacity < WIDTH:
        raise ValueError(f"capacity must be a positive multiple of {WIDTH}")
    spark, stage = docs.sparkSession, Staging(docs.sparkSession)
    cut = token_pieces(docs, path, end_id, capacity, id_col, text_col, with_ids)
    cut = stage.put(cut.withColumn("_class", F.ceil(F.col("length") / WIDTH).cast("int")), "pieces")
    histogram = {r["_class"]: r["count"] for r in cut.groupBy("_class").count().collect()}  # at most capacity / WIDTH rows
    ranges, used, base = [], dict.fromkeys(histogram, 0), 0
    for times, use in plan(histogram, capacity // WIDTH):
        for s, k in use.items():
            ranges.append((s, used[s], used[s] + times * k, k, base))
            used[s] += times * k
        base += times
    table = spark.createDataFrame(ranges, "_class int, _lo bigint, _hi bigint, _each bigint, _base bigint")
    ranked = numbered(cut, stage, "ranks", ["_class"], [id_col, "start", "ids_crc32"], "_rank")
    r, t = ranked.alias("r"), F.broadcast(table).alias("t")  # a few rows a pattern
    placed = r.join(t, (F.col("r._class") == F.col("t._class")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    placed = placed.select("r.*", (F.col("_base") + F.floor((F.col("_rank") - F.col("_lo")) / F.col("_each"))).cast("long").alias("sequence_id"))
    stage.drop("pieces")
    order = Window.partitionBy("sequence_id").orderBy(F.col("_class").desc(), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    return out.select(*[c for c in cut.columns if c != "_class"], "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
