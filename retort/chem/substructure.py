"""Pattern fingerprints and pattern filters over molecules in a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import properties as P
from .rings import molecule
from .smarts import View, pattern
from .smiles import Molecule, SmilesError
from .tables import ATOM_TYPES, GROUPS, KEYS, REACTIVE


def counted(patterns: Iterable[str], view: View, most: int | None = None) -> list[int]:
    return [pattern(p).count(view, most) for p in patterns]


def atom_type_counts(m: Molecule) -> list[int]:
    """How often each of the 110 atom types' patterns is found."""
    return counted((t[0] for t in ATOM_TYPES), P.view_of(m))


def key_counts(m: Molecule) -> list[int]:
    """How often each structural key is found. Key 0 counts parts, key 28 aromatic rings (by their
    bonds) and key 39 rings of eight atoms or more, in the place of what their patterns give."""
    view = P.view_of(m)
    out = [0 if p is None else pattern(p).count(view) for p in KEYS]
    near = m.neighbours
    seen: set[int] = set()
    for i in range(len(near)):
        if i not in seen:
            out[0] += 1
            todo = [i]
            while todo:
                a = todo.pop()
                if a not in seen:
                    seen.add(a)
                    todo += [j for j, _ in near[a]]
    flat = {frozenset((i, j)) for i, j, o in m.bonds if o == 1.5}
    out[28] = sum(all(frozenset(e) in flat for e in zip(r, r[1:] + r[:1], strict=True)) for r in m.rings)
    out[39] = sum(len(r) >= 8 for r in m.rings)
    return out


def by_text(batch: pa.RecordBatch, column: int, make: Callable[[Molecule], object], errors: str) -> list:
    """``make`` of each row's molecule, once for each different text; None for a text that is no SMILES."""
    known: dict[str | None, object] = {}
    out = []
    for text in batch.column(column).to_pylist():
        if text not in known:
            try:
                known[text] = make(molecule(text or ""))
            except SmilesError:
                if errors == "raise":
                    raise
                known[text] = None
        out.append(known[text])
    return out


def ensure_molecules(df: DataFrame, smiles: str, out: str = "is_molecule") -> DataFrame:
    """``df`` with whether a text column is a SMILES that the reader takes; null and empty texts are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = by_text(b, b.schema.get_field_index(smiles), lambda m: True, "null")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bool(x) for x in found], pa.bool_())], [*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType())]))


def require_molecules(df: DataFrame, smiles: str) -> DataFrame:
    """``df`` as it is; a row whose text is no SMILES is an error when it is read."""
    checked = ensure_molecules(df, smiles, "_is_molecule")
    fault = F.raise_error(F.concat(F.lit("no molecule: "), F.coalesce(F.col(smiles), F.lit("null")))).cast("boolean")
    return checked.filter(F.when(F.col("_is_molecule"), F.lit(True)).otherwise(fault)).select(*df.columns)


def vector_fingerprint(df: DataFrame, id_col: str, smiles: str, make: Callable[[Molecule], list], errors: str = "raise", count: bool = True) -> DataFrame:
    """(id, bit, count) of the entries of ``make(molecule)`` that are not 0; without ``count`` they are 1."""
    if errors not in ("raise", "ignore"):
        raise ValueError("errors must be raise or ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, bits, values = [], [], []
            for i, v in enumerate(by_text(b, 1, make, errors)):
                for k, x in enumerate(v or ()):
                    if x:
                        rows.append(i)
                        bits.append(k)
                        values.append(int(x) if count else 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(bits, pa.int32()), pa.array(values, pa.int64())], [id_col, "bit", "count"])

    schema = T.StructType([df.schema[id_col], T.StructField("bit", T.IntegerType()), T.StructField("count", T.LongType())])
    return df.select(id_col, smiles).mapInArrow(run, schema)


def pattern_fingerprint(df: DataFrame, id_col: str, smiles: str, patterns: list[str], count: bool = False, errors: str = "raise") -> DataFrame:
    """(id, bit, count): which of the given patterns a molecule holds, and how often with ``count``."""
    if not patterns or not all(isinstance(p, str) for p in patterns):
        raise ValueError("patterns must be a list of SMARTS texts, and not empty")
    for p in patterns:
        pattern(p)
    return vector_fingerprint(df, id_col, smiles, lambda m: counted(patterns, P.view_of(m), None if count else 1), errors, count)


def atom_type_fingerprint(df: DataFrame, id_col: str, smiles: str, count: bool = False, errors: str = "raise") -> DataFrame:
    """The 110 atom types of partition and refractivity as a pattern fingerprint."""
    return vector_fingerprint(df, id_col, smiles, atom_type_counts, errors, count)


def key_fingerprint(df: DataFrame, id_col: str, smiles: str, count: bool = True, errors: str = "raise") -> DataFrame:
    """The structural keys as a fingerprint."""
    return vector_fingerprint(df, id_col, smiles, key_counts, errors, count)


def group_fingerprint(df: DataFrame, id_col: str, smiles: str, count: bool = True, errors: str = "raise") -> DataFrame:
    """Functional groups as a pattern fingerprint; bits stand for GROUPS in their order."""
    return pattern_fingerprint(df, id_col, smiles, [p for _, p in GROUPS], count, errors)


def read_patterns(spark: SparkSession, path: str) -> list[tuple[str, str, int, bool]]:
    """(name, smarts, min_count, exclude) of a CSV with such a header; it may have one to a few thousand rows."""
    rows = spark.read.option("header", True).csv(path)
    least = F.coalesce(F.col("min_count").cast("int"), F.lit(1)) if "min_count" in rows.columns else F.lit(1)
    drop = F.coalesce(F.col("exclude").cast("boolean"), F.lit(True)) if "exclude" in rows.columns else F.lit(True)
    return [tuple(r) for r in rows.select("name", "smarts", least, drop).limit(100_000).collect()]


def filter_reactive(df: DataFrame, id_col: str, smiles: str, **options) -> DataFrame:
    """Molecules without a reactive group or a long chain; options are those of ``filter_by_patterns``."""
    return filter_by_patterns(df, id_col, smiles, [(name, p, 1, True) for name, p in REACTIVE], **options)


def filter_by_patterns(df: DataFrame, id_col: str, smiles: str, patterns: list[tuple[str, str, int, bool]], allow_one_violation: bool = False, severity: int = 10, return_type: str = "mol", errors: str = "raise") -> DataFrame:
    """Molecules without unwanted substructures: rows that pass (``mol``), all rows with ``passed``
    (``indicators``), or beside it the names of the patterns found (``condition_indicators``).

    A pattern (name, smarts, min_count, exclude) is found with ``min_count`` places or more. One
    that excludes is a violation, of which one is allowed if asked for; of the others, ``severity``
    found together reject the molecule. A text that is no SMILES raises or does not pass.
    """
    if return_type not in ("mol", "indicators", "condition_indicators") or errors not in ("raise", "ignore"):
        raise ValueError("unknown return_type or errors")
    if not patterns:
        raise ValueError("patterns must not be empty")
    for _, p, _, _ in patterns:
        pattern(p)

    def found(m: Molecule) -> list[int]:
        view = P.view_of(m)
        return [k for k, (_, p, least, _) in enumerate(patterns) if pattern(p).count(view, least) >= least]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            at = b.schema.get_field_index(smiles) if at is None else at
            hits = by_text(b, at, found, errors)
            bad = [sum(patterns[k][3] for k in h) if h is not None else len(patterns) + 1 for h in hits]
            passed = [x <= int(allow_one_violation) and len(h or ()) - x < severity for x, h in zip(bad, hits, strict=True)]
            columns = [*b.columns, pa.array(passed, pa.bool_()), pa.array([[patterns[k][0] for k in h or ()] for h in hits], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "passed", "found"])

    out = df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("passed", T.BooleanType()), T.StructField("found", T.ArrayType(T.StringType()))]))
    if return_type == "mol":
        return out.filter("passed").select(*df.columns)
    return out.drop("found") if return_type == "indicators" else out
