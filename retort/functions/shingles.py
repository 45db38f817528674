"""Fingerprints of strings: hashed substrings (LINGO) and hashed shingles folded to a size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lingo_text(smiles: Column) -> Column:
    """Ring numbers become 0, ``Cl`` becomes ``L`` and ``Br`` becomes ``R``."""
    return F.replace(F.replace(F.regexp_replace(smiles, "[1-9]", "0"), F.lit("Cl"), F.lit("L")), F.lit("Br"), F.lit("R"))


def substrings(text: Column, k: int) -> Column:
    """All substrings of k characters, in order; none for a shorter or null text."""
    length = F.length(text)
    return F.when(length >= k, F.transform(F.sequence(F.lit(1), length - k + 1), lambda i: text.substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def hex_mod(digits: Column, size: int, length: int) -> Column:
    """A hexadecimal string of ``length`` digits modulo ``size``, seven digits at a time."""
    out = F.lit(0).cast("bigint")
    for at in range(1, length + 1, 7):
        n = min(7, length - at + 1)
        part = F.conv(F.substring(digits, at, n), 16, 10).cast("bigint")
        out = F.pmod(out * F.lit(16**n % size).cast("bigint") + part, F.lit(size).cast("bigint"))
    return out


def lingo(df: DataFrame, id_col: str, smiles: str, fp_size: int = 1024, substring_length: int = 4) -> DataFrame:
    """(id, bit, count) of every non-zero slot: SHA-1 of each substring modulo ``fp_size``.

    Substrings are counted before they are hashed, so each differing one of a row is hashed once.
    """
    if fp_size < 1 or substring_length < 1:
        raise ValueError("fp_size and substring_length must be at least 1")
    grams = df.select(id_col, F.explode(substrings(lingo_text(F.col(smiles)), substring_length)).alias("gram"))
    digest = F.sha1(F.col("gram").cast("binary"))
    if fp_size & (fp_size - 1) == 0 and fp_size <= 1 << 28:
        slot = F.conv(F.right(digest, F.lit(7)), 16, 10).cast("bigint").bitwiseAND(F.lit(fp_size - 1))
    else:
        slot = hex_mod(digest, fp_size, 40)
    return grams.select(id_col, slot.cast("int").alias("bit")).groupBy(id_col, "bit").agg(F.count("*").alias("count"))


def fold_shingles(df: DataFrame, id_col: str, shingles: str, fp_size: int = 1024, count: bool = False) -> DataFrame:
    """(id, bit, count): the first four bytes of SHA-256, little-endian, modulo ``fp_size``."""
    s = F.sha2(F.col("_s").cast("binary"), 256)
    little = F.concat(F.substring(s, 7, 2), F.substring(s, 5, 2), F.substring(s, 3, 2), F.substring(s, 1, 2))
    bit = F.pmod(F.conv(little, 16, 10).cast("bigint"), F.lit(fp_size)).cast("int")
    slots = df.select(id_col, F.explode(shingles).alias("_s")).select(id_col, bit.alias("bit"))
    grouped = slots.groupBy(id_col, "bit").agg(F.count("*").alias("count"))
    return grouped if count else grouped.withColumn("count", F.lit(1).cast("bigint"))


def fold_ids(df: DataFrame, id_col: str, ids: str, fp_size: int, binary: bool = True) -> DataFrame:
    """(id, bit, count): sparse feature numbers modulo ``fp_size``, summed, at most 1 if binary."""
    slots = df.select(id_col, F.pmod(F.explode(ids), F.lit(fp_size).cast("bigint")).cast("int").alias("bit")).groupBy(id_col, "bit").agg(F.count("*").alias("count"))
    return slots.withColumn("count", F.least("count", F.lit(1)).cast("bigint")) if binary else slots
