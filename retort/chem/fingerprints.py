"""Graph fingerprints on own hashes: circular, atom pairs, torsions, linear paths; rule filters and scaffolds of molecules.

Feature numbers come from BLAKE2 over a written form, so they are the same everywhere but are
not those of any other package.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rules import RULE_SETS, apply_rules
from ..operators.splits import group_fill_split, randomized_group_split
from . import descriptors as D
from . import properties as P
from .rings import molecule
from .smarts import pattern
from .smiles import Molecule, SmilesError, largest_fragment
from .substructure import by_text


def number(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little") >> 1


def _atoms(m: Molecule) -> list[int]:
    near, rings = m.neighbours, {i for b in D.ring_bonds(m) for i in b}
    return [number(m.symbols[i], len(near[i]), m.hydrogens[i], m.charges[i], m.aromatic[i], i in rings) for i in range(len(m.symbols))]


# Donor, acceptor, aromatic, halogen, basic and acidic atoms.
FEATURES = (
    "[$([N;!H0;v3,v4&+1]),$([O,S;H1;+0]),n&H1&+0]",
    "[$([O,S;H1;v2;!$(*-*=[O,N,P,S])]),$([O,S;H0;v2]),$([O,S;-]),$([N;v3;!$(N-*=[O,N,P,S])]),n&H0&+0,$([o,s;+0;!$([o,s]:n);!$([o,s]:c:n)])]",
    "[a]",
    "[F,Cl,Br,I]",
    "[#7;+,$([N;H2&+0][$([C,a]);!$([C,a](=O))]),$([N;H1&+0]([$([C,a]);!$([C,a](=O))])[$([C,a]);!$([C,a](=O))]),$([N;H0&+0]([C;!$(C(=O))])([C;!$(C(=O))])[C;!$(C(=O))])]",
    "[$([C,S](=[O,S,P])-[O;H1,-1])]",
)


def features(m: Molecule) -> list[int]:
    """A bit for each of FEATURES an atom has."""
    view = P.view_of(m)
    tests = [pattern(t).atoms[0] for t in FEATURES]
    return [sum(1 << k for k, t in enumerate(tests) if t(view, i)) for i in range(len(m.symbols))]


def circular(m: Molecule, radius: int = 2, use_bond_types: bool = True, use_features: bool = False, use_chirality: bool = False) -> Counter:
    """Environments of each atom up to ``radius`` bonds; equal atom sets of a radius count once.

    Atoms start from their elements and bonds, or with ``use_features`` from what they do; with
    ``use_chirality`` marked centers are told apart.
    """
    near, now = m.neighbours, [number("features", x) for x in features(m)] if use_features else _atoms(m)
    if use_chirality:
        now = [number(x, m.chiral[i]) if m.chiral[i] else x for i, x in enumerate(now)]
    out, cover = Counter(now), [frozenset([i]) for i in range(len(now))]
    seen = set(cover)
    for r in range(1, radius + 1):
        now = [number(r, now[i], sorted((o if use_bond_types else 1, now[j]) for j, o in near[i])) for i in range(len(now))]
        cover = [cover[i].union(*(cover[j] for j, _ in near[i])) for i in range(len(now))]
        for c, n in sorted(zip(cover, now, strict=True), key=lambda x: x[1]):
            if c not in seen:
                seen.add(c)
                out[n] += 1
    return out


def atom_pairs(m: Molecule, least: int = 1, most: int = 30, use_features: bool = False, places: np.ndarray | None = None, scale_by_atoms: bool = False) -> Counter:
    """Pairs of atom types with the bonds between them, or with their distance in space, rounded
    down, if ``places`` of a conformer are given. ``scale_by_atoms`` gives counts per heavy atom, in hundredths."""
    d, own = D.distances(m), ([(x,) for x in features(m)] if use_features else _types(m))
    n = len(own)
    if places is not None:
        d = np.floor(np.sqrt(((places[:, None] - places[None]) ** 2).sum(-1)))
    if scale_by_atoms:
        plain = atom_pairs(m, least, most, use_features, places)
        heavy = max(1, sum(s != "H" for s in m.symbols))
        return Counter({k: -(-100 * v // heavy) for k, v in plain.items()})
    return Counter(number(*sorted((own[i], own[j])), int(d[i, j])) for i in range(n) for j in range(i + 1, n) if least <= d[i, j] <= most)


def _types(m: Molecule) -> list[tuple]:
    return [(s, len(x), sum(o > 1 for _, o in x)) for s, x in zip(m.symbols, m.neighbours, strict=True)]


def _walks(m: Molecule, atoms: int) -> Iterator[tuple[int, ...]]:
    near = m.neighbours
    todo = [(i,) for i in range(len(m.symbols))]
    while todo:
        w = todo.pop()
        if len(w) == atoms:
            if w[0] <= w[-1]:
                yield w
            continue
        todo += [(*w, j) for j, _ in near[w[-1]] if j not in w]


def torsions(m: Molecule, atoms: int = 4) -> Counter:
    own = _types(m)
    return Counter(number(min(k := [own[i] for i in w], k[::-1])) for w in _walks(m, atoms))


def linear_paths(m: Molecule, least: int = 1, most: int = 7) -> Counter:
    order = {frozenset((i, j)): o for i, j, o in m.bonds}
    out: Counter = Counter()
    for bonds in range(least, most + 1):
        for w in _walks(m, bonds + 1):
            key = [x for i, a in enumerate(w) for x in ([order[frozenset((w[i - 1], a))]] if i else []) + [(m.symbols[a], m.aromatic[a])]]
            out[number(min(repr(key), repr(key[::-1])))] += 1
    return out


def layered(m: Molecule, least: int = 1, most: int = 7) -> Counter:
    """Linear paths in layers that tell apart ever more: length, bond orders, elements, rings, ring sizes, aromaticity."""
    order = {frozenset((i, j)): o for i, j, o in m.bonds}
    sizes: list[list[int]] = [[] for _ in m.symbols]
    for r in m.rings or ():
        for a in r:
            sizes[a].append(len(r))
    cyclic = {frozenset(e) for r in m.rings or () for e in zip(r, r[1:] + r[:1], strict=True)}
    layers = (
        lambda a: 0, lambda a: m.symbols[a], lambda a: (m.symbols[a], bool(sizes[a])), lambda a: (m.symbols[a], min(sizes[a], default=0)), lambda a: (m.symbols[a], m.aromatic[a]),
    )
    out: Counter = Counter()
    for bonds in range(least, most + 1):
        for w in _walks(m, bonds + 1):
            ties = [order[frozenset(e)] for e in zip(w, w[1:], strict=False)]
            marks = [(o, frozenset(e) in cyclic) for o, e in zip(ties, zip(w, w[1:], strict=False), strict=True)]
            for k, atom in enumerate(layers):
                edges = [0] * bonds if k == 0 else marks if k == 3 else ties
                key = [x for i, a in enumerate(w) for x in ([edges[i - 1]] if i else []) + [atom(a)]]
                out[number(k, min(repr(key), repr(key[::-1])))] += 1
            key = ties
            out[number("order", min(repr(key), repr(key[::-1])))] += 1
    return out


KINDS: dict[str, Callable[..., Counter]] = {"circular": circular, "atom_pairs": atom_pairs, "torsions": torsions, "linear_paths": linear_paths, "layered": layered}


def fingerprint(df: DataFrame, id_col: str, smiles: str, kind: str = "circular", fp_size: int = 2048, count: bool = False, errors: str = "raise", count_simulation: bool = False, **options) -> DataFrame:
    """(id, bit, count) of every non-zero slot; a text that is no SMILES raises or is left out.

    With ``count_simulation`` a feature has four slots, set if it is found 1, 2, 4 and 8 times or more.
    """
    if kind not in KINDS or fp_size < 1 or errors not in ("raise", "ignore"):
        raise ValueError("unknown kind, size or errors")
    make = KINDS[kind]

    def folded(m: Molecule) -> list[tuple[int, int]]:
        slots: Counter = Counter()
        for n, k in make(m, **options).items():
            if count_simulation:
                base = n % max(1, fp_size // 4) * 4
                slots.update({base + t: 1 for t, least in enumerate((1, 2, 4, 8)) if k >= least})
            else:
                slots[n % fp_size] += k
        return sorted(slots.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, bits, counts = [], [], []
            for i, found in enumerate(by_text(b, 1, folded, errors)):
                for slot, k in found or ():
                    rows.append(i)
                    bits.append(slot)
                    counts.append(k if count else 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(bits, pa.int32()), pa.array(counts, pa.int64())], [id_col, "bit", "count"])

    schema = T.StructType([df.schema[id_col], T.StructField("bit", T.IntegerType()), T.StructField("count", T.LongType())])
    return df.select(id_col, smiles).mapInArrow(run, schema)


MOLECULE = "atoms array<struct<symbol: string, charge: int, hydrogens: int, aromatic: boolean>>, bonds array<struct<i: int, j: int, order: double>>"


def read_molecules(df: DataFrame, id_col: str, smiles: str, errors: str = "raise") -> DataFrame:
    """(id, atoms, bonds) of each SMILES: elements, charges, hydrogens and aromaticity of the atoms, ends
    and order of the bonds (1.5 if aromatic). What is no SMILES raises, or gives nulls with errors "null"."""
    kinds = [pa.list_(pa.struct([("symbol", pa.string()), ("charge", pa.int32()), ("hydrogens", pa.int32()), ("aromatic", pa.bool_())])), pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("order", pa.float64())]))]

    def made(m: Molecule) -> tuple[list[dict], list[dict]]:
        atoms = zip(m.symbols, m.charges, m.hydrogens, m.aromatic, strict=True)
        return [{"symbol": s, "charge": q, "hydrogens": h, "aromatic": a} for s, q, h, a in atoms], [{"i": i, "j": j, "order": o} for i, j, o in m.bonds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = by_text(b, 1, made, errors)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] if r else None for r in rows], kind) for k, kind in enumerate(kinds))], [id_col, "atoms", "bonds"])

    return df.select(id_col, smiles).mapInArrow(run, T.StructType([df.schema[id_col], *T._parse_datatype_string(MOLECULE).fields]))


#: All descriptors by name.
DESCRIPTORS = {**D.DESCRIPTORS, **P.PROPERTIES}
#: Other names of descriptors.
RULE_NAMES = {"mol_weight": "molecular_weight", "rings": "number_of_rings", "heavy_atoms": "heavy_atom_count", "number_of_rotatable_bonds": "rotatable_bonds"}


def describe(df: DataFrame, id_col: str, smiles: str, names: tuple[str, ...] = tuple(D.DESCRIPTORS), errors: str = "null") -> DataFrame:
    """(id, one double a descriptor); a text that is no SMILES gives nulls or raises."""
    makers = [DESCRIPTORS[RULE_NAMES.get(n, n)] for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = by_text(b, 1, lambda m: [float(f(m)) for f in makers], errors)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] if r else None for r in rows], pa.float64()) for k in range(len(names)))], [id_col, *names])

    schema = T.StructType([df.schema[id_col], *(T.StructField(n, T.DoubleType()) for n in names)])
    return df.select(id_col, smiles).mapInArrow(run, schema)


def filter_molecules(df: DataFrame, id_col: str, smiles: str, rules: str, allow_one_violation: bool | None = None, return_type: str = "mol", errors: str = "null") -> DataFrame:
    """A rule set applied to molecules in a text column: their descriptors are computed, only those
    the rules ask for. Rows (id, text) as ``apply_rules`` returns them; what is no SMILES does not pass."""
    chosen = RULE_SETS[rules]
    names = tuple(dict.fromkeys(n for n, _, _ in chosen.rules))
    described = describe(df.select(F.struct(id_col, smiles).alias("row"), F.col(smiles).alias("text")), "row", "text", names, errors)
    out = apply_rules(described, chosen, allow_one_violation, return_type)
    return out.select("row.*", *(c for c in out.columns if c != "row" and (c not in names or return_type == "condition_indicators")))


def scaffold_key(m: Molecule, generic: bool = False) -> str:
    """A key of the ring systems and linkers: side chains are cut off, the rest is hashed by
    neighbourhoods. Molecules without a ring share the empty key."""
    near = m.neighbours
    keep = set(range(len(m.symbols)))
    while True:
        ends = {i for i in keep if sum(j in keep for j, _ in near[i]) <= 1}
        if not ends:
            break
        keep -= ends
    if not keep:
        return ""
    now = {i: 0 if generic else number(m.symbols[i], m.aromatic[i]) for i in keep}
    for _ in range(len(keep)):
        now = {i: number(now[i], sorted((1 if generic else o, now[j]) for j, o in near[i] if j in keep)) for i in keep}
    return f"{number(sorted(now.values())):016x}"


def scaffolds(df: DataFrame, id_col: str, smiles: str, out: str = "scaffold", generic: bool = False, errors: str = "raise") -> DataFrame:
    """``df`` with the scaffold key of each molecule; null for a text that is no SMILES, if that does not raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            at = b.schema.get_field_index(smiles) if at is None else at
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(by_text(b, at, lambda m: scaffold_key(m, generic), errors), pa.string())], [*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def scaffold_split(df: DataFrame, id_col: str, smiles: str, valid: int, test: int, generic: bool = False, seed: int | None = None) -> DataFrame:
    """``df`` with ``subset``: whole scaffolds go to test, then valid, then train, the smallest
    first, or in a seeded order of their own. Molecules without a ring share a scaffold."""
    keyed = scaffolds(df, id_col, smiles, "_scaffold", generic)
    if seed is None:
        return group_fill_split(keyed, F.col("_scaffold"), id_col, valid, test).drop("_scaffold")
    return randomized_group_split(keyed, F.col("_scaffold"), id_col, valid, test, seed).drop("_scaffold")


def standardise(df: DataFrame, id_col: str, smiles: str, errors: str = "raise") -> DataFrame:
    """``df`` with the largest part of each molecule in the place of the whole."""
    if errors not in ("raise", "null"):
        raise ValueError("errors must be raise or null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(smiles)
            texts = []
            for t in b.column(at).to_pylist():
                try:
                    texts.append(largest_fragment(t or ""))
                except SmilesError:
                    if errors == "raise":
                        raise
                    texts.append(None)
            columns = [*b.columns]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return df.mapInArrow(run, df.schema)
