"""Exact duplicates by a tree-merge of digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Staging, text_or_empty, unused

#: What must agree for two texts to count as equal: the digest, then two independent checks.
SAME = ("_sha", "_check", "_length")


def _digest(df: DataFrame, text: Column) -> DataFrame:
    return df.withColumn("_sha", F.unhex(F.sha2(text.cast("binary"), 256))).withColumn("_check", F.xxhash64(text)).withColumn("_length", F.octet_length(text))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 8, levels: int = 2, normalise=None) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Rows are dealt to fan_in**levels runs by a hash of id and text, each run holds a digest
    once, and rounds of fan_in-way merges (log2(fan_in) binomial steps each) bring the runs
    together until one is left, which is dealt over all tasks by digest. Each level keeps the
    smallest (``keep="min"``) or largest id and the count, and merges entries only if digest,
    second hash and length agree. The decisions go down the same tree, so a text that a third
    of all rows share is never one task's work: at a join inside the tree a key has at most
    ``fan_in`` entries, and at the leaves its rows are spread over all runs.

    Cases: null text counts as empty; ``normalise`` maps the text column before comparison;
    rows with one id and one text share a decision; a null id never stays if its group has
    another id, and a group of null ids only keeps all its rows; an empty table gives an
    empty table; other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be min or max")
    if fan_in < 2 or levels < 1:
        raise ValueError("fan_in must be at least 2 and levels at least 1")
    stage = Staging(docs.sparkSession)
    text = text_or_empty(text_col)
    keyed = _digest(docs.select(F.col(id_col).alias("_id"), text_col), normalise(text) if normalise else text)
    keyed = keyed.withColumn("_run", F.pmod(F.xxhash64("_id", "_check"), F.lit(fan_in**levels)).cast("int")).drop(text_col)
    leaves = stage.put(keyed, "digests")
    best = F.max if keep == "max" else F.min
    tables = [leaves.groupBy("_run", *SAME).agg(best("_id").alias("_keep"), F.count("*").alias("_n"))]
    for level in range(levels):
        tables[-1] = stage.put(tables[-1], f"runs-{level}")
        up = tables[-1].withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int"))
        tables.append(up.groupBy("_run", *SAME).agg(best("_keep").alias("_keep"), F.sum("_n").alias("_n")))
    decided = tables[-1]
    for below in reversed(tables[:-1]):
        entries = below.select("_run", *SAME).withColumn("_up", F.floor(F.col("_run") / fan_in).cast("int"))
        decided = entries.join(decided.withColumnRenamed("_run", "_up"), ["_up", *SAME]).select("_run", *SAME, "_keep", "_n")
    return leaves.join(decided, ["_run", *SAME]).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, each (id, text) once, with all their columns.

    Options and cases are those of ``decisions``.
    """
    verdicts = decisions(docs, id_col, text_col, **options).filter("kept")
    staying = verdicts.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_hex")).distinct()
    normalise = options.get("normalise")
    text = text_or_empty(text_col)
    own = unused(docs, "_hex2")
    rows = docs.withColumn(own, F.sha2((normalise(text) if normalise else text).cast("binary"), 256))
    on = rows[id_col].eqNullSafe(staying["_id"]) & (rows[own] == staying["_hex"])
    names = docs.columns
    return rows.join(staying, on, "left_semi").dropDuplicates([id_col, own]).select(*names)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
