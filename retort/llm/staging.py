"""Staged tables in the cluster's shared folder, dense numbering and bounded Bloom bitmaps."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a local one if all runs on
    this machine (tests), else an error: executors elsewhere would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    there = spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="retort-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


#: Rows of an Arrow batch while a table is written.
BATCH_ROWS = 2_000


class Staging:
    """Tables of one operator call, written once so that lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/retort-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it again. Texts are long, so Arrow batches are kept small meanwhile."""
        path, rows = f"{self.root}/{name}", "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(rows)
        if not 0 < int(before) <= BATCH_ROWS:
            self.spark.conf.set(rows, str(BATCH_ROWS))
        try:
            df.write.mode("error").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(rows, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of finished writes now, not at some later collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        """Deletes a table that no later result reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, stage: Staging, name: str, keys: list[str], order: list[str], out: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Adds ``out``: numbers from 0 without gaps within ``keys``, without one task for a key.

    Rows of a key are dealt to hashed buckets whose count follows the table's size; each
    bucket is numbered by itself and starts where the buckets before it end.
    """
    total = df.count()
    buckets = max(1, -(-total // rows_per_bucket))
    b, r, n, s = (unused(df, x) for x in ("_b", "_r", "_n", "_s"))
    spread = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    local = spread.withColumn(r, F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)).cast("long") - 1)
    local = stage.put(local, f"{name}-local")
    counts = local.groupBy(*keys, b).agg(F.count("*").alias(n))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(s))
    on = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in [*keys, b]]
    joined = local.alias("l").join(starts.alias("s"), on)
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col(f"l.{r}") + F.col(f"s.{s}")).alias(out))


def bitmap(hashes: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """One-hash Bloom bitmap of a long column as uint64 words: 2**bits bits at any input size.

    Only a filter: what passes is joined exactly afterwards, so a full bitmap costs time, never rows.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("b"))
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    got = words.toArrow()
    if got.num_rows:
        table[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return table


def bits_for(hashes: DataFrame, most: int = 28) -> int:
    """Bits of a bitmap with eight bits a row, 2**20 to 2**most."""
    return min(most, max(20, (8 * hashes.count()).bit_length()))


def in_bitmap(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(table) * 64 - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Renames columns of ``df`` that clash with names an operator adds."""
    taken = {n.lower() for n in names}
    for c in df.columns:
        if c.lower() in taken:
            new = f"{c}_in"
            while new.lower() in taken | {x.lower() for x in df.columns}:
                new += "_in"
            df = df.withColumnRenamed(c, new)
    return df


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores behind as no column of ``df`` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
