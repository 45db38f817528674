"""Peptides of amino acid letters as SMILES."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each residue in a chain, from its nitrogen to its carbonyl.
RESIDUES = {
    "A": "N[C@@H](C)C(=O)", "C": "N[C@@H](CS)C(=O)", "D": "N[C@@H](CC(=O)O)C(=O)", "E": "N[C@@H](CCC(=O)O)C(=O)", "F": "N[C@@H](Cc1ccccc1)C(=O)",
    "G": "NCC(=O)", "H": "N[C@@H](Cc1c[nH]cn1)C(=O)", "I": "N[C@@H]([C@@H](C)CC)C(=O)", "K": "N[C@@H](CCCCN)C(=O)", "L": "N[C@@H](CC(C)C)C(=O)",
    "M": "N[C@@H](CCSC)C(=O)", "N": "N[C@@H](CC(=O)N)C(=O)", "P": "N1CCC[C@H]1C(=O)", "Q": "N[C@@H](CCC(=O)N)C(=O)", "R": "N[C@@H](CCCNC(=N)N)C(=O)",
    "S": "N[C@@H](CO)C(=O)", "T": "N[C@@H]([C@@H](C)O)C(=O)", "V": "N[C@@H](C(C)C)C(=O)", "W": "N[C@@H](Cc1c[nH]c2ccccc12)C(=O)", "Y": "N[C@@H](Cc1ccc(O)cc1)C(=O)",
}


def peptide(sequence: Column) -> Column:
    """SMILES of a chain of one-letter residues, first to last; null for a null, empty or unknown sequence."""
    known = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    letters = F.split(F.upper(F.trim(sequence)), "")
    parts = F.transform(letters, lambda a: F.element_at(known, a))
    whole = (F.length(F.trim(sequence)) > 0) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(whole, F.concat(F.array_join(parts, ""), F.lit("O")))


def peptide_smiles(df: DataFrame, sequence: str, out: str = "smiles", errors: str = "raise") -> DataFrame:
    """``df`` with the SMILES of each sequence; one that has another letter raises, or is null with errors "null"."""
    if errors not in ("raise", "null"):
        raise ValueError("errors must be raise or null")
    made = peptide(F.col(sequence))
    if errors == "raise":
        made = F.when(F.col(sequence).isNull() | made.isNotNull(), made).otherwise(F.raise_error(F.concat(F.lit("no peptide: "), F.col(sequence))))
    return df.withColumn(out, made)
