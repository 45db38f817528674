"""A corpus from raw documents to packed sequences, one operator a stage.

Every stage works on all rows its predecessor kept. All but the last return the columns of
``documents``; the last returns pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retort.llm import decontamination, exact_dedup, near_dedup, packing, quality
from retort.llm.staging import Staging


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the factorisation machine scores under 0.3.

    Cases: null and empty texts are scored by structure alone; without labelled rows the machine
    scores 0.5 and all stay; repeated rows are judged alike; an empty table stays empty.
    """
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, machine, out="_quality")
    return scored.filter("_quality >= 0.3").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every text, once.

    Cases: a null text is equal to an empty one; a row with a null id stays only where no other
    row has its text; an empty table stays empty.
    """
    return exact_dedup.exact_dedup(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every component of links at a similarity of 0.8 over five-word shingles.

    Cases: texts without words and rows with a null id all stay; rows with one id stay or go
    together; an empty table stays empty.
    """
    return near_dedup.keep_one(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage.

    Cases: null and empty texts stay; repeated rows stay or go alike; an empty benchmark drops
    nothing; an empty table stays empty.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens.

    Cases: a null or empty text is one end token; rows with one id are packed each for itself; an
    empty table gives no piece.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", classify), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: No SQL: a trained classifier, signatures and a linear program; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage has read is deleted once it is written."""
    docs, stage, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Staging(spark), ""
    for name, function in STAGES[:-1]:
        docs = stage.put(function(spark, docs, sf_dir), name)
        if before:
            stage.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
