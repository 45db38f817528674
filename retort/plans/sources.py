"""Queries of readers and writers: files are written from the test tables, read back and held against SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import datasets, files
from ..sources.scratch import scratch


def _part(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _copied(spark, source: str, target: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def _label(k: int) -> str:
    """The label of task k of a row of ``part``, the same text in both engines; some are missing."""
    return f"CASE WHEN (p_partkey + {k}) % 11 = 0 THEN NULL ELSE (p_partkey * {k + 1}) % 7 END"


def load_datasets(spark, sf_dir: str) -> DataFrame:
    """(dataset, task, n_rows, labelled, total, places): every dataset's loader over a file of its name with
    as many tasks, made of all rows of ``part`` in the order of their keys."""
    root, part = scratch(spark), _part(spark, sf_dir).orderBy("p_partkey")
    made: dict[int, str] = {}
    out = []
    for d in datasets.DATASETS.values():
        path = f"{root}/{d.stem}.csv"
        if d.tasks in made:
            _copied(spark, made[d.tasks], path)
        else:
            part.select(F.col("p_name").alias("SMILES"), *(F.expr(_label(k)).alias(f"t{k}") for k in range(d.tasks))).write.option("header", True).csv(path)
            made[d.tasks] = path
        rows = datasets.read_dataset(spark, root, d.name)
        out.append(rows.groupBy("task").agg(F.count("*").alias("n_rows"), F.count("y").alias("labelled"), F.sum("y").alias("total"), F.sum(F.col("y") * F.col("row_id")).alias("places")).select(F.lit(d.name).alias("dataset"), "*"))
    return reduce(DataFrame.unionAll, out)


def _all_tasks() -> str:
    return ", ".join(f"('{d.name}', {d.tasks})" for d in datasets.DATASETS.values())


LOAD_SQL = f"""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part), k AS (SELECT range AS k FROM range(617)),
l AS (SELECT k, count(*) AS n_rows, count(y) AS labelled, sum(y)::DOUBLE AS total, sum(y * row_id)::DOUBLE AS places FROM (SELECT k, row_id, CASE WHEN (p_partkey + k) % 11 = 0 THEN NULL ELSE (p_partkey * (k + 1)) % 7 END AS y FROM p, k) GROUP BY k)
SELECT dataset, 't' || k AS task, n_rows, labelled, total, places FROM (VALUES {_all_tasks()}) d(dataset, tasks) JOIN l ON k < tasks"""


def load_peptides(spark, sf_dir: str) -> DataFrame:
    """Amino sequences with standardised labels: (row_id, text, task, y)."""
    root = scratch(spark)
    part = _part(spark, sf_dir).orderBy("p_partkey")
    part.select(F.lit("C").alias("SMILES"), F.col("p_brand").alias("aminoseq"), *(F.expr(_label(k)).alias(f"t{k}") for k in range(3))).write.option("header", True).csv(f"{root}/peptides_struct.csv")
    out = datasets.read_dataset(spark, root, "peptides_struct", "aminoseq", standardize=True)
    return out.select("row_id", "text", "task", F.round("y", 6).alias("y"))


PEPTIDES_SQL = """WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part),
l AS (SELECT row_id, p_brand AS text, 't' || k AS task, (CASE WHEN (p_partkey + k) % 11 = 0 THEN NULL ELSE (p_partkey * (k + 1)) % 7 END)::DOUBLE AS y FROM p, (SELECT range AS k FROM range(3)))
SELECT row_id, text, task, round((y - avg(y) OVER (PARTITION BY task)) / stddev_pop(y) OVER (PARTITION BY task), 6) AS y FROM l"""

#: One dataset of each group, and its kinds of split files.
SPLITS = (("peptides_func", "default"), ("chembl204_ki", "random"), ("chembl204_ki", "activity_cliff"), ("bace", "default"), ("ames", "default"))


def load_splits(spark, sf_dir: str) -> DataFrame:
    """(dataset, split_type, subset, idx) of split files made of the keys of ``part``."""
    root, part, out = scratch(spark), _part(spark, sf_dir), []
    for i, (name, kind) in enumerate(SPLITS):
        lists = part.agg(*(F.sort_array(F.collect_list(F.when((F.col("p_partkey") + i) % 10 == at, F.col("p_partkey")))).alias(s) for s, at in (("train", 0), ("valid", 1), ("test", 2))))
        lists.write.json(f"{root}/{datasets.DATASETS[name].stem}_{datasets.SPLIT_FILES[kind]}.json")
        out.append(datasets.read_dataset_splits(spark, root, name, kind).select(F.lit(name).alias("dataset"), F.lit(kind).alias("split_type"), "subset", "idx"))
    return reduce(DataFrame.unionAll, out)


SPLITS_SQL = "SELECT dataset, split_type, subset, p_partkey AS idx FROM part, (VALUES " + ", ".join(f"('{n}', '{k}', {i})" for i, (n, k) in enumerate(SPLITS)) + ") d(dataset, split_type, i) JOIN (VALUES ('train', 0), ('valid', 1), ('test', 2)) s(subset, r) ON true WHERE (p_partkey + i) % 10 = r"

#: Made-up molecules of two or three atoms in both engines: symbol, x, y, z of atom k.
_ATOM = "CASE (p_partkey + {k}) % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'N' ELSE 'Cl' END"


def sdf_round_trip(spark, sf_dir: str) -> DataFrame:
    """(title, n_atoms, n_bonds, symbol, x, y, z, i): atoms of molecules written as SDF and read again."""
    path = f"{scratch(spark)}/mols"
    atom = lambda k: F.struct((F.col("p_size") + k).cast("double").alias("x"), (F.col("p_partkey") % 1000 / 8.0 - 60).alias("y"), F.lit(-0.5 * k).alias("z"), F.expr(_ATOM.format(k=k)).alias("symbol"))
    bond = lambda k: F.struct(F.lit(k).alias("i"), F.lit(k + 1).alias("j"), (1 + F.col("p_partkey") % 3).cast("int").alias("order"))
    n = 2 + F.col("p_partkey") % 2
    made = _part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("title"), F.slice(F.array(atom(0), atom(1), atom(2)), F.lit(1), n.cast("int")).alias("atoms"), F.slice(F.array(bond(0), bond(1)), F.lit(1), (n - 1).cast("int")).alias("bonds"))
    files.write_sdf(made, path)
    back = files.read_sdf(spark, path).select(F.col("title").cast("long").alias("title"), F.size("atoms").alias("n_atoms"), F.size("bonds").alias("n_bonds"), F.aggregate("bonds", F.lit(0), lambda s, b: s + b["order"]).alias("orders"), F.posexplode("atoms").alias("i", "a"))
    return back.select("title", "n_atoms", "n_bonds", "orders", "i", "a.symbol", "a.x", "a.y", "a.z")


SDF_SQL = f"SELECT p_partkey AS title, (2 + p_partkey % 2)::INT AS n_atoms, (1 + p_partkey % 2)::INT AS n_bonds, ((1 + p_partkey % 2) * (1 + p_partkey % 3))::INT AS orders, k::INT AS i, {_ATOM.format(k='k')} AS symbol, (p_size + k)::DOUBLE AS x, (p_partkey % 1000) / 8.0::DOUBLE - 60 AS y, (-0.5 * k)::DOUBLE AS z FROM part, (SELECT range AS k FROM range(3)) WHERE k < 2 + p_partkey % 2"


def fasta_round_trip(spark, sf_dir: str) -> DataFrame:
    """(seq_id, seq): sequences over two lines each."""
    path = f"{scratch(spark)}/seqs"
    letters = F.translate(F.upper("p_name"), " ", "")
    _part(spark, sf_dir).select(F.concat(F.lit(">s"), F.col("p_partkey"), F.lit(" some note\n"), F.substring(letters, 1, 10), F.lit("\n"), letters.substr(F.lit(11), F.length(letters)))).write.text(path)
    return files.read_fasta(spark, path)


FASTA_SQL = "SELECT 's' || p_partkey AS seq_id, replace(upper(p_name), ' ', '') AS seq FROM part"

QUERIES = {"load_datasets": load_datasets, "load_peptides_standardized": load_peptides, "load_splits": load_splits, "sdf_round_trip": sdf_round_trip, "fasta_round_trip": fasta_round_trip}
SQL = {"load_datasets": LOAD_SQL, "load_peptides_standardized": PEPTIDES_SQL, "load_splits": SPLITS_SQL, "sdf_round_trip": SDF_SQL, "fasta_round_trip": FASTA_SQL}
