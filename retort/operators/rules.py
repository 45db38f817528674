"""Physicochemical filters as data: a rule is a descriptor with an inclusive range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Bound = float | int | None


@dataclass(frozen=True)
class RuleSet:
    """Rules (descriptor, least, most); ``lenient``: whether one violation is allowed by default."""

    rules: tuple[tuple[str, Bound, Bound], ...]
    lenient: bool = False


def _set(*rules: tuple[str, Bound, Bound], lenient: bool = False) -> RuleSet:
    return RuleSet(rules, lenient)


# The published thresholds of each rule set. None leaves a side open.
RULE_SETS: dict[str, RuleSet] = {
    "beyond_ro5": _set(("mol_weight", None, 1000), ("logp", -2, 10), ("hba", None, 15), ("hbd", None, 6), ("tpsa", None, 250), ("rotatable_bonds", None, 20)),
    "faf4_druglike": _set(("mol_weight", 100, 600), ("logp", -3, 6), ("hba", None, 12), ("hbd", None, 7), ("tpsa", None, 180), ("rotatable_bonds", None, 11), ("rigid_bonds", None, 30), ("rings", None, 6), ("max_ring_size", None, 18), ("carbons", 3, 35), ("heteroatoms", 1, 15), ("non_carbon_ratio", 0.1, 1.1), ("charged_groups", None, 4), ("formal_charge", -4, 4)),
    "faf4_leadlike": _set(("mol_weight", 150, 400), ("logp", -3, 4), ("hba", None, 7), ("hbd", None, 4), ("tpsa", None, 160), ("rotatable_bonds", None, 9), ("rigid_bonds", None, 30), ("rings", None, 4), ("max_ring_size", None, 18), ("carbons", 3, 35), ("heteroatoms", 1, 15), ("non_carbon_ratio", 0.1, 1.1), ("charged_groups", None, 4), ("formal_charge", -4, 4), ("stereo_centers", None, 2)),
    "ghose": _set(("mol_weight", 160, 400), ("logp", -0.4, 5.6), ("atoms", 20, 70), ("refractivity", 40, 130)),
    "gsk": _set(("mol_weight", None, 400), ("logp", None, 4)),
    "hao": _set(("mol_weight", None, 435), ("logp", None, 6), ("hbd", None, 2), ("hba", None, 6), ("rotatable_bonds", None, 9), ("aromatic_bonds", None, 17)),
    "lipinski": _set(("mol_weight", None, 500), ("lipinski_hba", None, 10), ("lipinski_hbd", None, 5), ("logp", None, 5), lenient=True),
    "mol_weight": _set(("mol_weight", 0, 1000)),
    "oprea": _set(("hbd", None, 2), ("hba", 2, 9), ("rotatable_bonds", 2, 8), ("rings", 1, 4)),
    "pfizer": _set(("logp", None, 3), ("tpsa", 75, None)),
    "reos": _set(("exact_weight", 200, 500), ("logp", -5, 5), ("hba", None, 10), ("hbd", None, 5), ("formal_charge", -2, 2), ("rotatable_bonds", None, 8), ("heavy_atoms", 15, 50)),
    "rule_of_four": _set(("mol_weight", 400, None), ("logp", 4, None), ("hba", 4, None), ("rings", 4, None)),
    "rule_of_three": _set(("mol_weight", None, 300), ("hba", None, 3), ("hbd", None, 3), ("logp", None, 3)),
    "rule_of_three_extended": _set(("mol_weight", None, 300), ("hba", None, 3), ("hbd", None, 3), ("logp", None, 3), ("rotatable_bonds", None, 3), ("tpsa", None, 60)),
    "rule_of_two": _set(("mol_weight", None, 200), ("hba", None, 4), ("hbd", None, 2), ("logp", None, 2)),
    "rule_of_veber": _set(("rotatable_bonds", None, 10), ("tpsa", None, 140)),
    "rule_of_xu": _set(("hbd", None, 5), ("hba", None, 10), ("rotatable_bonds", 2, 35), ("rings", 1, 7), ("heavy_atoms", 10, 50)),
    "tice_herbicides": _set(("mol_weight", 150, 500), ("logp", None, 3.5), ("hbd", None, 3), ("hba", 2, 12), ("rotatable_bonds", None, 11)),
    "tice_insecticides": _set(("mol_weight", 150, 500), ("logp", 0, 5), ("hbd", None, 2), ("hba", 1, 8), ("rotatable_bonds", None, 11)),
    "valence_discovery": _set(("mol_weight", 200, 600), ("logp", -3, 6), ("hba", None, 12), ("hbd", None, 7), ("tpsa", 40, 180), ("rotatable_bonds", None, 15), ("rigid_bonds", None, 30), ("aromatic_rings", None, 5), ("fused_aromatic_rings", None, 2), ("max_ring_size", None, 18), ("heavy_atoms", None, 69), ("heavy_metals", None, 0), ("carbons", 3, 40), ("heteroatoms", 1, 15), ("formal_charge", -2, 2), ("charged_atoms", None, 2)),
    "zinc_druglike": _set(("mol_weight", 60, 600), ("logp", -4, 6), ("hba", None, 11), ("hbd", None, 6), ("tpsa", None, 150), ("rotatable_bonds", None, 12), ("rigid_bonds", None, 50), ("rings", None, 7), ("max_ring_size", None, 12), ("carbons", 3, None), ("non_carbon_ratio", None, 2), ("charged_groups", None, 4), ("formal_charge", -4, 4)),
}


def rule_column(name: str, least: Bound, most: Bound) -> Column:
    out = F.lit(True)
    if least is not None:
        out = out & (F.col(name) >= least)
    if most is not None:
        out = out & (F.col(name) <= most)
    return F.coalesce(out, F.lit(False))


def rule_name(name: str, least: Bound, most: Bound) -> str:
    return f"ok_{name}"


def passes(rules: list[Column], allow_one_violation: bool) -> Column:
    held = sum((r.cast("int") for r in rules), F.lit(0))
    return held >= len(rules) - int(allow_one_violation)


def apply_rules(df: DataFrame, rules: RuleSet | str, allow_one_violation: bool | None = None, return_type: str = "mol") -> DataFrame:
    """Rows that pass (``mol``), a column ``passed`` (``indicators``), or one column a rule beside
    it (``condition_indicators``). A null descriptor breaks its rule. Labels stay with their rows."""
    if return_type not in ("mol", "indicators", "condition_indicators"):
        raise ValueError("return_type must be mol, indicators or condition_indicators")
    chosen = RULE_SETS[rules] if isinstance(rules, str) else rules
    lenient = chosen.lenient if allow_one_violation is None else allow_one_violation
    columns = [rule_column(*r) for r in chosen.rules]
    passed = passes(columns, lenient)
    if return_type == "mol":
        return df.filter(passed)
    out = df.withColumn("passed", passed)
    if return_type == "condition_indicators":
        out = out.withColumns({rule_name(*r): c for r, c in zip(chosen.rules, columns, strict=True)})
    return out


def pattern_filter(matches: DataFrame, id_col: str, hits: str = "hits", allow_one_violation: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """Substructure filters over (id, pattern, hits): a row passes without a matching pattern, or
    with exactly one where that is allowed. Null hits are none. Rows of ``ids`` (all molecules)
    that have no match pass; without ``ids`` only rows of ``matches`` are judged."""
    n = F.sum((F.coalesce(F.col(hits), F.lit(0)) > 0).cast("int"))
    counts = matches.groupBy(id_col).agg(n.alias("n_matches"))
    if ids is not None:
        every = ids.select(F.col(id_col).alias("_id")).distinct()
        joined = every.join(counts, every["_id"].eqNullSafe(counts[id_col]), "left")
        counts = joined.select(F.col("_id").alias(id_col), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))
    return counts.withColumn("passed", F.col("n_matches") <= (1 if allow_one_violation else 0))
