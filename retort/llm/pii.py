"""Personal data: fixed kinds by pattern, and terms that disclose them by corpus co-occurrence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import Staging, bitmap, in_bitmap, unused
from .words import Words, pieces

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these two always takes whole runs of digits, so none starts inside a run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: a match is the longest run of local characters before an
    ``@`` (from the last match's end on) and the domain behind it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        else:
            end = max(end, at)
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) of every fixed kind, by start, then kind."""
    out = []
    if "@" in text:
        out += [("email", a, b, text[a:b].lower()) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", m.start(), m.end(), m[0]))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 10 <= len(digits) <= 15:
                out.append(("phone", m.start(), m.end(), digits))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _hash(values: list[bytes]) -> np.ndarray:
    return Words(pa.array([v.decode() for v in values], pa.string()), lower=True, space=np.zeros(256, bool)).hash


def _free(begins: np.ndarray, ends: np.ndarray, base: list[tuple[str, int, int, str]]) -> np.ndarray:
    """True for each word (sorted places) that touches no span of ``base`` (sorted by start)."""
    if not base:
        return np.ones(len(begins), bool)
    reach = np.maximum.accumulate([b for _, _, b, _ in base])
    before = np.searchsorted([a for _, a, _, _ in base], ends)  # spans that start before the word's end
    return (before == 0) | (reach[before - 1] <= begins)


def _may_hold(batch: pa.RecordBatch) -> np.ndarray:
    """Rows with a digit or an ``@``: no kind matches without one."""
    w = Words(batch.column("text"))
    table = np.zeros(256, bool)
    table[[*range(48, 58), 64]] = True
    total = np.concatenate(([0], np.cumsum(table[w.bytes])))
    return np.diff(total[w.offsets]) > 0


def disclosing_terms(scanned: DataFrame, docs: DataFrame, stage: Staging, min_contexts: int, min_probability: float, min_npmi: float) -> DataFrame:
    """(entity, term): terms whose presence tells which protected value a document holds.

    Candidates are the pairs that stand near each other anywhere. All counts are of whole documents
    (rows with a word at least): those that hold the entity and the term, the entity, the term, and
    all. A pair in fewer than ``min_contexts`` documents does not count. With P(entity | term) at
    least ``min_probability`` and normalised pointwise mutual information at least ``min_npmi`` the
    term discloses.
    """
    entities = stage.put(scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= min_contexts), "entities")
    # A term near values in so many documents is in as many at least, and no pair is in more than
    # its entity: an exact bound that spares counting usual words.
    near = scanned.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["term"]))).alias("term")).groupBy("term").agg(F.count("*").alias("_m"))
    pairs = F.array_distinct(F.transform("near", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))
    joint = scanned.select(F.explode(pairs).alias("x")).select("x.*").distinct().join(entities, "entity").join(near, "term")
    joint = stage.put(joint.filter(F.col("n_e") / F.col("_m") >= min_probability).drop("_m"), "joint")
    context = docs.sparkSession.sparkContext
    terms, values = (context.broadcast(bitmap(joint.select(c).distinct(), c, 22)) for c in ("term", "entity"))  # 2**22 bits each
    pairs = context.broadcast(bitmap(joint.select(F.col("entity").bitwiseXOR(F.col("term")).alias("pair")), "pair", 24))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[int | None, int]] = Counter()
        for batch in pieces(batches):
            w = Words(batch.column("text"), lower=True)
            some = in_bitmap(terms.value, w.hash)
            one = np.unique(np.column_stack([w.rows()[some].astype(np.uint64), w.hash[some]]), axis=0)
            first = np.searchsorted(one[:, 0], np.arange(batch.num_rows + 1))
            seen, n = np.unique(one[:, 1], return_counts=True)
            for t, k in zip(seen.view(np.int64).tolist(), n.tolist(), strict=True):
                held[None, t] += k
            for i in np.flatnonzero(_may_hold(batch) & (np.diff(first) > 0)).tolist():
                base = base_spans(batch.column("text")[i].as_py())
                if base:
                    entity = np.unique(_hash([f"{k}:{v}".encode() for k, _, _, v in base]))
                    here = np.ascontiguousarray(one[first[i] : first[i + 1], 1])
                    for e in entity[in_bitmap(values.value, entity)]:
                        held.update((int(e.view(np.int64)), t) for t in here[in_bitmap(pairs.value, here ^ e)].view(np.int64).tolist())
                    if len(held) > 200_000:
                        yield counted(held)
                        held.clear()
            if len(held) > 200_000:
                yield counted(held)
                held.clear()
        yield counted(held)

    def counted(held: Counter[tuple[int | None, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e for e, _ in held], pa.int64()), pa.array([t for _, t in held], pa.int64()), pa.array(held.values(), pa.int64())], ["entity", "term", "n"])

    counts = docs.select("text").mapInArrow(count, "entity long, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("n"))
    counts = stage.put(counts, "counts")
    total = docs.filter(F.col("text").rlike(_WORD.pattern)).count()
    frequency = counts.filter("entity is null").select("term", F.col("n").alias("n_t"))
    both = joint.join(counts.filter("entity is not null").withColumnRenamed("n", "n_et"), ["entity", "term"]).filter(F.col("n_et") >= min_contexts).join(frequency, "term")
    p_et = F.col("n_et") / F.lit(float(max(total, 1)))
    pmi = F.log(F.col("n_et") * F.lit(float(max(total, 1))) / (F.col("n_t") * F.col("n_e")))
    npmi = F.when(p_et < 1, pmi / -F.log(p_et)).otherwise(F.lit(1.0))
    return both.filter((F.col("n_et") / F.col("n_t") >= min_probability) & (npmi >= min_npmi)).select("entity", "term")


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(_id, _t, a, b): every place of one of ``terms`` in every text, but for words that touch a protected value."""
    table = docs.sparkSession.sparkContext.broadcast(bitmap(terms, "term", 22))  # 2**22 bits

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = Words(batch.column("text"), lower=True)
            some = in_bitmap(table.value, w.hash)
            may, at, places = _may_hold(batch), [], []
            for i in np.unique(w.rows()[some]).tolist():
                text = batch.column("text")[i].as_py()
                base = base_spans(text) if may[i] else []
                words = np.array([m.span() for m in _WORD.finditer(text)])
                chosen = np.flatnonzero(some[w.first[i] : w.first[i + 1]] & _free(words[:, 0], words[:, 1], base))
                for j, (a, b) in zip(chosen.tolist(), words[chosen].tolist(), strict=True):
                    at.append(i)
                    places.append((int(w.hash[w.first[i] + j].view(np.int64)), a, b))
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("_id", "_t")]
            columns += [pa.array([p[k] for p in places], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_t", "term", "a", "b"])

    schema = T.StructType([docs.schema["_id"], docs.schema["_t"], *T._parse_datatype_string("term long, a int, b int").fields])
    return docs.mapInArrow(find, schema).join(terms, "term", "left_semi").select("_id", "_t", "a", "b")


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 8, min_contexts: int = 3, min_probability: float = 0.5, min_npmi: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, all_spans.

    A word within ``reach`` words of a protected value anywhere may be a term; one that discloses
    the value (see ``disclosing_terms``) becomes a span of kind ``term`` wherever it stands, in all
    texts, with the value or without.
    base_sha256 is over the fixed kinds alone, spans holds all (kind:start:end in code points,
    end exclusive), all_spans the same as an array for ``sanitise``.

    Cases: a null text is empty and has no span; repeated rows each get their own row with the
    same spans; null ids are matched as equal; an empty table gives an empty table; other
    columns are ignored.
    """
    stage = Staging(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text")
            counts = np.zeros((batch.num_rows, len(KINDS)), np.int64)
            spans: list[list[str]] = [[] for _ in range(batch.num_rows)]
            near: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            held: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(_may_hold(batch)).tolist():
                text = texts[i].as_py()
                base = base_spans(text)
                if not base:
                    continue
                for kind, a, b, _ in base:
                    counts[i, KINDS.index(kind)] += 1
                    spans[i].append(f"{kind}:{a}:{b}")
                words = np.array([m.span() for m in _WORD.finditer(text)])
                begins, change = words[:, 0], np.zeros(len(words) + 1, np.int64)
                lows = np.searchsorted(begins, [a for _, a, _, _ in base], side="right") - 1 - reach
                highs = np.searchsorted(begins, [b for _, _, b, _ in base]) + reach
                np.add.at(change, np.maximum(lows, 0), 1)
                np.add.at(change, np.minimum(highs, len(words)), -1)
                place = np.flatnonzero((np.cumsum(change)[:-1] > 0) & _free(begins, words[:, 1], base))
                own = _hash([text[a:b].encode() for a, b in words[place].tolist()]).view(np.int64)
                entity = _hash([f"{k}:{v}".encode() for k, _, _, v in base])
                held[i] = np.unique(entity.view(np.int64)).tolist()
                for lo, hi, e in zip(np.searchsorted(place, lows).tolist(), np.searchsorted(place, highs).tolist(), entity.view(np.int64).tolist(), strict=True):
                    near[i] += [{"entity": e, "term": t} for t in own[lo:hi].tolist()]
            kind = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))
            columns = [batch.column("_id"), batch.column("_t"), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(spans, pa.list_(pa.string())), pa.array(near, kind), pa.array(held, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_t", *(f"n_{k}" for k in KINDS), "base", "near", "entities"])

    extra = ", ".join(f"n_{k} long" for k in KINDS) + ", base array<string>, near array<struct<entity: long, term: long>>, entities array<long>"
    schema = T.StructType([source.schema["_id"], source.schema["_t"], *T._parse_datatype_string(extra).fields])
    scanned = stage.put(source.mapInArrow(scan, schema), "scanned")
    terms = stage.put(disclosing_terms(scanned, source, stage, min_contexts, min_probability, min_npmi).select("term").distinct(), "terms")
    for name in ("entities", "joint", "counts"):
        stage.drop(name)
    added = occurrences(source, terms)
    added = added.groupBy("_id", "_t").agg(F.collect_set(F.concat_ws(":", F.lit("term"), "a", "b")).alias("terms"))  # at most the words of a text
    s, t = scanned.drop("near", "entities").alias("s"), added.alias("t")
    joined = s.join(t, F.col("s._id").eqNullSafe(F.col("t._id")) & F.col("s._t").eqNullSafe(F.col("t._t")), "left").select("s.*", "t.terms")
    rank = lambda x: F.struct(F.get(F.split(x, ":"), F.lit(1)).cast("int").alias("a"), F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "term")]), F.get(F.split(x, ":"), F.lit(0))).alias("k"), x.alias("s"))
    every = F.transform(F.array_sort(F.transform(F.concat("base", F.coalesce("terms", F.array().cast("array<string>"))), rank)), lambda x: x.s)
    out = joined.withColumn("all_spans", every)
    return out.select(F.col("_id").alias(id_col), *(f"n_{k}" for k in KINDS), F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join("all_spans", ",").alias("spans"), "all_spans", "_t")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its protected values generalised to ``[KIND]`` and disclosing terms to ``[TERM]``.

    Cases are those of ``pii``: null texts stay null, empty ones empty, repeated rows change alike,
    rows with a null id too; an empty table gives an empty table; all columns are kept.
    """
    spans = pii(docs, id_col, text_col, **options).filter("size(all_spans) > 0").select(F.col(id_col).alias("_i"), F.col("_t").alias("_h"), "all_spans").dropDuplicates(["_i", "_h"])
    names, where = docs.columns, docs.columns.index(text_col)
    x, found = unused(docs, "_x"), unused(docs, "_spans")
    rows = docs.withColumn(x, F.xxhash64(text_col)).alias("d").join(spans.alias("s"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("s._i")) & (F.col(f"d.{x}") == F.col("s._h")), "left")
    rows = rows.select(*(F.col(f"d.`{c}`") for c in names), F.col("s.all_spans").alias(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for i, spans in enumerate(batch.column(found).to_pylist()):
                if spans:
                    out, end = [], 0
                    for s in spans:
                        kind, a, b = s.split(":")
                        if int(b) > end:
                            out += [texts[i][end : int(a)], f"[{kind.upper()}]" if int(a) >= end else ""]
                            end = int(b)
                    texts[i] = "".join(out) + texts[i][end:]
            columns = [*batch.columns[: len(names)]]
            columns[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, docs.schema)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    out = pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")
