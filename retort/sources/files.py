"""Readers and writers: SDF (V2000), FASTA, tables with label columns and split files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """(title, atoms, bonds, properties, block): one row for each molecule block of an SDF file or folder;
    properties are the data items behind a block, as an array of name and value.

    The text source splits at ``$$$$``, so a file is read in parallel; fields stand at fixed
    places of the V2000 format.
    """
    raw = spark.read.option("lineSep", "$$$$").text(path).select(F.regexp_replace("value", r"\A\r?\n", "").alias("block")).filter(F.length(F.trim("block")) > 0)
    lines = raw.withColumn("lines", F.split("block", r"\r?\n")).filter(F.size("lines") >= 4)
    counts = F.get("lines", F.lit(3))
    rows = lines.withColumn("na", F.trim(F.substring(counts, 1, 3)).cast("int")).withColumn("nb", F.trim(F.substring(counts, 4, 3)).cast("int"))
    number = lambda s, at, n, kind: F.trim(F.substring(s, at, n)).cast(kind)
    atom = lambda s: F.struct(number(s, 1, 10, "double").alias("x"), number(s, 11, 10, "double").alias("y"), number(s, 21, 10, "double").alias("z"), F.trim(F.substring(s, 32, 3)).alias("symbol"))
    bond = lambda s: F.struct((number(s, 1, 3, "int") - 1).alias("i"), (number(s, 4, 3, "int") - 1).alias("j"), number(s, 7, 3, "int").alias("order"))
    item = lambda k: F.regexp_extract_all("block", F.lit(r"(?m)^> +(?:\([^)]*\) *)?<([^>]+)>[^\r\n]*\r?\n([^\r\n]*)"), F.lit(k))
    properties = F.transform(F.arrays_zip(item(1).alias("name"), item(2).alias("value")), lambda p: F.struct(p["name"].alias("name"), F.trim(p["value"]).alias("value"))).alias("properties")
    return rows.select(F.trim(F.get("lines", F.lit(0))).alias("title"), F.transform(F.slice("lines", F.lit(5), F.col("na")), atom).alias("atoms"), F.transform(F.slice("lines", F.col("na") + 5, F.col("nb")), bond).alias("bonds"), properties, "block")


def sdf_block(title: Column, atoms: Column, bonds: Column) -> Column:
    """A V2000 block of atoms and bonds as ``read_sdf`` gives them."""
    place = lambda v: F.lpad(F.format_string("%.4f", v), 10, " ")
    pad = lambda v, n=3: F.lpad(v.cast("string"), n, " ")
    atom = lambda a: F.concat(place(a["x"]), place(a["y"]), place(a["z"]), F.lit(" "), F.rpad(a["symbol"], 3, " "), F.lit(" 0  0  0  0  0  0  0  0  0  0  0  0"))
    bond = lambda b: F.concat(pad(b["i"] + 1), pad(b["j"] + 1), pad(b["order"]), F.lit("  0"))
    head = F.concat(pad(F.size(atoms)), pad(F.size(bonds)), F.lit("  0  0  0  0  0  0  0  0999 V2000"))
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.lit(""), F.lit(""), head, F.array_join(F.transform(atoms, atom), "\n"), F.when(F.size(bonds) > 0, F.array_join(F.transform(bonds, bond), "\n")), F.lit("M  END"), F.lit("$$$$"))


def write_sdf(df: DataFrame, path: str, title: str = "title", atoms: str = "atoms", bonds: str = "bonds") -> None:
    df.select(sdf_block(F.col(title), F.col(atoms), F.col(bonds)).alias("value")).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq) of a FASTA file or folder; the id is the header's first word."""
    raw = spark.read.option("lineSep", ">").text(path).filter(F.length(F.trim("value")) > 0)
    return raw.select(F.regexp_extract("value", r"\A\s*(\S+)", 1).alias("seq_id"), F.regexp_replace(F.regexp_replace("value", r"\A[^\n]*\n?", ""), r"\s", "").alias("seq"))


def numbered_rows(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Rows of files with their place from 0 without gaps: rows of a block of a file are numbered
    by themselves and start where the blocks before it end, so no task holds more than a block."""
    where = {"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()}
    rows = df.withColumns(where)
    blocks = rows.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))  # a row a block
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return rows.join(starts, ["_file", "_at"]).withColumn(out, F.col("_start") + F.col("_id") - F.col("_first")).drop("_file", "_at", "_id", "_first", "_start")


def read_table(spark: SparkSession, path: str, strings: str = "SMILES", labels: list[str] | None = None) -> DataFrame:
    """(row_id, text, task, y): a CSV with a molecule column, its label columns as a long table.

    Missing and NaN labels become null. row_id is the row's place in the file, or in a folder's
    files by name.
    """
    df = spark.read.option("header", True).csv(path)
    tasks = labels or [c for c in df.columns if c not in ("SMILES", "aminoseq", strings)]
    wide = numbered_rows(df)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(f"`{t}`").cast("double").alias("y")) for t in tasks]))
    long = wide.select("row_id", F.col(strings).alias("text"), each.alias("l")).select("row_id", "text", "l.task", "l.y")
    return long.withColumn("y", F.when(~F.isnan("y"), F.col("y")))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(subset, idx) of a JSON object of index lists."""
    df = spark.read.option("multiLine", True).json(path)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("subset"), F.col(c).cast("array<bigint>").alias("all")) for c in df.columns]))
    return df.select(each.alias("s")).select("s.subset", F.explode("s.all").alias("idx"))
