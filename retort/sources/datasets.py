"""Benchmark datasets as data: one reader for all of them, from files the user has."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_splits, read_table


@dataclass(frozen=True)
class Dataset:
    group: str
    category: str
    name: str
    tasks: int
    kind: str
    rows: int
    split: str
    metric: str

    @property
    def stem(self) -> str:
        return f"tdc_{self.name}" if self.group == "tdc" else self.name


# Group, category, name, tasks, kind, rows, recommended split, metric.
TABLE = (
    ("lrgb", "", "peptides_func", 10, "classification", 15535, "stratified random", "AUPRC"),
    ("lrgb", "", "peptides_struct", 11, "regression", 15535, "stratified random", "MAE"),
    ("moleculeace", "", "chembl204_ki", 1, "regression", 2754, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl214_ki", 1, "regression", 3317, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl218_ec50", 1, "regression", 1031, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl219_ki", 1, "regression", 1865, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl228_ki", 1, "regression", 1704, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl231_ki", 1, "regression", 973, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl233_ki", 1, "regression", 3142, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl234_ki", 1, "regression", 3657, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl235_ec50", 1, "regression", 2349, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl236_ki", 1, "regression", 2598, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl237_ec50", 1, "regression", 955, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl237_ki", 1, "regression", 2603, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl238_ki", 1, "regression", 1052, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl239_ec50", 1, "regression", 1721, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl244_ki", 1, "regression", 3097, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl262_ki", 1, "regression", 856, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl264_ki", 1, "regression", 2862, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl287_ki", 1, "regression", 1328, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl1862_ki", 1, "regression", 794, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl1871_ki", 1, "regression", 659, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl2034_ki", 1, "regression", 750, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl2047_ec50", 1, "regression", 631, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl2147_ki", 1, "regression", 1456, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl2835_ki", 1, "regression", 615, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl2971_ki", 1, "regression", 976, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl3979_ec50", 1, "regression", 1125, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl4005_ki", 1, "regression", 960, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl4203_ki", 1, "regression", 731, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl4616_ec50", 1, "regression", 682, "activity_cliff", "RMSE"),
    ("moleculeace", "", "chembl4792_ki", 1, "regression", 1471, "activity_cliff", "RMSE"),
    ("moleculenet", "", "bace", 1, "classification", 1513, "scaffold", "AUROC"),
    ("moleculenet", "", "bbbp", 1, "classification", 2039, "scaffold", "AUROC"),
    ("moleculenet", "", "clintox", 2, "multitask classification", 1477, "scaffold", "AUROC"),
    ("moleculenet", "", "esol", 1, "regression", 1128, "scaffold", "RMSE"),
    ("moleculenet", "", "freesolv", 1, "regression", 642, "scaffold", "RMSE"),
    ("moleculenet", "", "hiv", 1, "classification", 41127, "scaffold", "AUROC"),
    ("moleculenet", "", "lipophilicity", 1, "regression", 4200, "scaffold", "RMSE"),
    ("moleculenet", "", "muv", 17, "multitask classification", 93087, "scaffold", "AUPRC, AUROC"),
    ("moleculenet", "", "pcba", 128, "multitask classification", 437929, "scaffold", "AUPRC, AUROC"),
    ("moleculenet", "", "sider", 27, "multitask classification", 1427, "scaffold", "AUROC"),
    ("moleculenet", "", "tox21", 12, "multitask classification", 7831, "scaffold", "AUROC"),
    ("moleculenet", "", "toxcast", 617, "multitask classification", 8576, "scaffold", "AUROC"),
    ("tdc", "ADME", "b3db_classification", 1, "classification", 6167, "scaffold", "AUROC"),
    ("tdc", "ADME", "b3db_regression", 1, "regression", 942, "scaffold", "MAE"),
    ("tdc", "ADME", "bioavailability_ma", 1, "classification", 640, "scaffold", "AUROC"),
    ("tdc", "ADME", "caco2_wang", 1, "regression", 910, "scaffold", "MAE"),
    ("tdc", "ADME", "clearance_hepatocyte_az", 1, "regression", 1213, "scaffold", "Spearman correlation"),
    ("tdc", "ADME", "clearance_microsome_az", 1, "regression", 1102, "scaffold", "Spearman correlation"),
    ("tdc", "ADME", "cyp1a2_veith", 1, "classification", 12579, "scaffold", "AUPRC"),
    ("tdc", "ADME", "cyp2c9_substrate_carbonmangels", 1, "classification", 669, "scaffold", "AUPRC"),
    ("tdc", "ADME", "cyp2c9_veith", 1, "classification", 12092, "scaffold", "AUPRC"),
    ("tdc", "ADME", "cyp2c19_veith", 1, "classification", 12665, "scaffold", "AUPRC"),
    ("tdc", "ADME", "cyp2d6_substrate_carbonmangels", 1, "classification", 667, "scaffold", "AUPRC"),
    ("tdc", "ADME", "cyp2d6_veith", 1, "classification", 13130, "scaffold", "AUPRC"),
    ("tdc", "ADME", "cyp3a4_substrate_carbonmangels", 1, "classification", 670, "scaffold", "AUROC"),
    ("tdc", "ADME", "cyp3a4_veith", 1, "classification", 12328, "scaffold", "AUPRC"),
    ("tdc", "ADME", "half_life_obach", 1, "regression", 667, "scaffold", "Spearman correlation"),
    ("tdc", "ADME", "hia_hou", 1, "classification", 578, "scaffold", "AUROC"),
    ("tdc", "ADME", "hlm", 1, "classification", 6013, "scaffold", "AUROC"),
    ("tdc", "ADME", "pampa_approved_drugs", 1, "classification", 142, "scaffold", "AUROC"),
    ("tdc", "ADME", "pampa_ncats", 1, "classification", 2034, "scaffold", "AUROC"),
    ("tdc", "ADME", "pgp_broccatelli", 1, "classification", 1218, "scaffold", "AUROC"),
    ("tdc", "ADME", "ppbr_az", 1, "regression", 1614, "scaffold", "MAE"),
    ("tdc", "ADME", "rlm", 1, "classification", 6013, "scaffold", "AUROC"),
    ("tdc", "ADME", "solubility_aqsoldb", 1, "regression", 9982, "scaffold", "MAE"),
    ("tdc", "ADME", "vdss_lombardo", 1, "regression", 1130, "scaffold", "Spearman correlation"),
    ("tdc", "HTS", "sarscov2_3clpro_diamond", 1, "classification", 880, "scaffold", "AUROC"),
    ("tdc", "HTS", "sarscov2_vitro_touret", 1, "classification", 1484, "scaffold", "AUROC"),
    ("tdc", "Toxicity", "ames", 1, "classification", 7278, "scaffold", "AUROC"),
    ("tdc", "Toxicity", "carcinogens_lagunin", 1, "classification", 280, "scaffold", "AUROC"),
    ("tdc", "Toxicity", "dili", 1, "classification", 475, "scaffold", "AUROC"),
    ("tdc", "Toxicity", "herg", 1, "classification", 655, "scaffold", "AUROC"),
    ("tdc", "Toxicity", "herg_central_at_1um", 1, "regression", 306893, "scaffold", "MAE"),
    ("tdc", "Toxicity", "herg_central_at_10um", 1, "regression", 306893, "scaffold", "MAE"),
    ("tdc", "Toxicity", "herg_central_inhib", 1, "classification", 306893, "scaffold", "AUROC"),
    ("tdc", "Toxicity", "herg_karim", 1, "classification", 13445, "scaffold", "AUROC"),
    ("tdc", "Toxicity", "ld50_zhu", 1, "regression", 7385, "scaffold", "MAE"),
    ("tdc", "Toxicity", "skin_reaction", 1, "classification", 404, "scaffold", "AUROC"),
)
DATASETS = {row[2]: Dataset(*row) for row in TABLE}
#: Beside the kinds and categories of the table: names of subsets of a group.
SUBSETS = {
    "regression": lambda d: d.kind == "regression",
    "classification": lambda d: d.kind.endswith("classification"),
    "classification_single_task": lambda d: d.kind == "classification",
    "classification_multitask": lambda d: d.kind == "multitask classification" and d.name != "pcba",
    "classification_no_pcba": lambda d: d.kind.endswith("classification") and d.name != "pcba",
}
SPLIT_FILES = {"default": "splits", "random": "splits", "activity_cliff": "splits_activity"}


def data_home(root: str | None = None) -> str:
    """The folder of the dataset files: the one given, else ~/retort_data."""
    return (root or os.path.join(os.path.expanduser("~"), "retort_data")).rstrip("/")


def _known(name: str) -> Dataset:
    if name.lower() not in DATASETS:
        raise ValueError(f"unknown dataset {name}")
    return DATASETS[name.lower()]


def read_dataset(spark: SparkSession, root: str | None, name: str, text: str = "SMILES", standardize: bool = False) -> DataFrame:
    """(row_id, text, task, y) of a dataset's CSV under ``root``.

    ``text`` is the column of molecules: SMILES, or aminoseq where the file has it. With
    ``standardize`` each task's labels have mean 0 and deviation 1 (constant ones are 0).
    """
    if text not in ("SMILES", "aminoseq"):
        raise ValueError("text must be SMILES or aminoseq")
    out = read_table(spark, f"{data_home(root)}/{_known(name).stem}.csv", text)
    if not standardize:
        return out
    moments = out.groupBy("task").agg(F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"))  # a row a task
    return out.join(F.broadcast(moments), "task").select("row_id", "text", "task", F.when(F.col("_s") == 0, F.col("y") * 0).otherwise(F.try_divide(F.col("y") - F.col("_m"), F.col("_s"))).alias("y"))


def read_dataset_splits(spark: SparkSession, root: str | None, name: str, split_type: str = "default") -> DataFrame:
    """(subset, idx) of a dataset's split file, beside its CSV."""
    if split_type not in SPLIT_FILES:
        raise ValueError(f"split_type must be one of {sorted(SPLIT_FILES)}")
    return read_splits(spark, f"{data_home(root)}/{_known(name).stem}_{SPLIT_FILES[split_type]}.json")


def subset_names(group: str, subset: str | list[str] | None = None) -> list[str]:
    """Names of a group's datasets: all, a named subset, a category, or those listed."""
    of_group = [d for d in DATASETS.values() if d.group == group]
    if not of_group:
        raise ValueError(f"unknown group {group}")
    if subset is None:
        return [d.name for d in of_group]
    if isinstance(subset, str):
        chosen = [d.name for d in of_group if subset in SUBSETS and SUBSETS[subset](d) or subset.lower() == d.category.lower() != ""]
        if not chosen:
            raise ValueError(f"unknown subset {subset} of {group}")
        return chosen
    wrong = [n for n in subset if n.lower() not in {d.name for d in of_group}]
    if wrong:
        raise ValueError(f"{wrong} are not in {group}")
    return [n.lower() for n in subset]


def read_benchmark(spark: SparkSession, root: str | None, group: str, subset: str | list[str] | None = None, split_type: str | None = None, **options) -> dict[str, DataFrame]:
    """Lazy DataFrames of a group's datasets; with ``split_type`` those rows' subset stands beside them."""
    out = {}
    for name in subset_names(group, subset):
        df = read_dataset(spark, root, name, **options)
        if split_type:
            df = df.join(read_dataset_splits(spark, root, name, split_type).withColumnRenamed("idx", "row_id"), "row_id", "left")
        out[name] = df
    return out
