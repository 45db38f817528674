"""SMILES of molecules and of parts of them in an order of their own, and shingles made of such parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..memo import Memo
from . import descriptors as D
from .rings import molecule
from .smiles import Molecule, SmilesError, usual_hydrogens
from .substructure import by_text

_SIGNS = {1.0: "", 2.0: "=", 3.0: "#", 4.0: "$", 1.5: ":"}


def ranks(m: Molecule, atoms: list[int], root: int | None = None, hydrogens: bool = True) -> dict[int, int]:
    """A different number for each of ``atoms`` that does not depend on how the molecule was written:
    neighbourhoods tell atoms apart, and of those still alike one after the other is set before the rest."""
    held = set(atoms)
    near = {i: [(j, o) for j, o in pairs if j in held] for i, pairs in enumerate(m.neighbours) if i in held}
    start = {i: (i != root, m.symbols[i], m.aromatic[i], m.charges[i], m.isotopes[i], m.hydrogens[i] if hydrogens else 0, len(near[i])) for i in atoms}

    def numbered(keys: dict) -> dict[int, int]:
        place = {k: n for n, k in enumerate(sorted(set(keys.values())))}
        return {i: place[k] for i, k in keys.items()}

    now = numbered(start)
    while True:
        while True:
            after = numbered({i: (now[i], tuple(sorted((o, now[j]) for j, o in near[i]))) for i in atoms})
            if len(set(after.values())) == len(set(now.values())):
                break
            now = after
        if len(set(now.values())) == len(atoms):
            return now
        times: dict[int, int] = {}
        for v in now.values():
            times[v] = times.get(v, 0) + 1
        tied = min(v for v, n in times.items() if n > 1)
        first = min(i for i, v in now.items() if v == tied)  # any of them gives the same text
        now = numbered({i: (v, i != first) for i, v in now.items()})


def _atom(m: Molecule, i: int, hydrogens: bool) -> str:
    name = m.symbols[i].lower() if m.aromatic[i] else m.symbols[i]
    plain = m.symbols[i] in ("B", "C", "N", "O", "P", "S", "F", "Cl", "Br", "I") and not m.charges[i] and not m.isotopes[i]
    if plain and (not hydrogens or usual_hydrogens(m.symbols[i], m.aromatic[i], [o for _, o in m.neighbours[i]]) == m.hydrogens[i]):
        return name
    h = m.hydrogens[i] if hydrogens else 0
    q = m.charges[i]
    sign = ("+" if q > 0 else "-") * min(abs(q), 1) + (str(abs(q)) if abs(q) > 1 else "")
    return f"[{m.isotopes[i] or ''}{name}{'H' + (str(h) if h > 1 else '') if h else ''}{sign}]"


def to_smiles(m: Molecule, atoms: list[int] | None = None, root: int | None = None, hydrogens: bool = True) -> str:
    """The molecule, or the part of it on ``atoms``, as SMILES in its own order, from ``root`` on if given.
    Chirality and bond directions are not written."""
    atoms = list(range(len(m.symbols))) if atoms is None else atoms
    rank, held = ranks(m, atoms, root, hydrogens), set(atoms)
    near = {i: sorted(((rank[j], j, o) for j, o in m.neighbours[i] if j in held)) for i in atoms}
    seen: set[int] = set()
    parts = []
    for start in sorted(atoms, key=rank.get):
        if start in seen:
            continue
        order, parent, closures, todo = [], {start: -1}, [], [(start, -1)]
        placed: dict[int, int] = {}
        while todo:  # atoms in the order they are written; what leads back is a ring
            a, before = todo.pop()
            if a in seen:
                continue
            seen.add(a)
            parent[a] = before
            placed[a] = len(order)
            order.append(a)
            todo += [(j, a) for _, j, _ in reversed(near[a]) if j not in seen]
        for a in order:
            closures += [(placed[j], placed[a], j, a, o) for _, j, o in near[a] if placed[j] < placed[a] and parent[a] != j]
        opens: dict[int, list[tuple[int, str]]] = {}
        for n, (_, _, j, a, o) in enumerate(sorted(closures), 1):
            mark = str(n) if n < 10 else f"%{n}"
            sign = "" if o == 1.5 else "-" if o == 1 and m.aromatic[a] and m.aromatic[j] else _SIGNS[o]
            opens.setdefault(j, []).append((n, sign + mark))
            opens.setdefault(a, []).append((n, mark))
        children: dict[int, list[int]] = {a: [] for a in order}
        for a in order[1:]:
            children[parent[a]].append(a)
        tie = {frozenset((i, j)): o for i, j, o in m.bonds}
        text: list[str] = []
        stack: list[int | str] = [start]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                text.append(x)
                continue
            if parent[x] >= 0:
                o = tie[frozenset((x, parent[x]))]
                both = m.aromatic[x] and m.aromatic[parent[x]]
                text.append("" if o == 1.5 and both else "-" if o == 1 and both else _SIGNS[o])
            text.append(_atom(m, x, hydrogens) + "".join(t for _, t in sorted(opens.get(x, []))))
            after = children[x]
            for k, c in reversed(list(enumerate(after))):
                if k < len(after) - 1:
                    stack += [")", c, "("]
                else:
                    stack.append(c)
        parts.append("".join(text))
    return ".".join(sorted(parts))


def environment(m: Molecule, center: int, radius: int) -> str | None:
    """SMILES, from the center on, of what lies within ``radius`` bonds; None if nothing lies at that distance."""
    reached, edge = {center}, {center}
    for _ in range(radius):
        edge = {j for i in edge for j, _ in m.neighbours[i]} - reached
        if not edge:
            return None
        reached |= edge
    return to_smiles(m, sorted(reached), center, hydrogens=False)


def circular_shingles(m: Molecule, radius: int = 3, min_radius: int = 1, rings: bool = True) -> list[str]:
    """Different environments of ``min_radius`` to ``radius`` bonds (of 0 bonds the atom itself), and the smallest rings."""
    out = {to_smiles(m, sorted(r)) for r in m.rings} if rings else set()
    for r in range(min_radius, radius + 1):
        out |= {e for i in range(len(m.symbols)) if (e := environment(m, i, r)) is not None}
    return sorted(out)


def pair_shingles(m: Molecule, radius: int = 2, duplicates: bool = False) -> list[str]:
    """environment|distance|environment of every pair of atoms for each radius from 1, the lesser first.
    With ``duplicates`` a repeated one goes on with its number."""
    d, out = D.distances(m), []
    n = len(m.symbols)
    for r in range(1, radius + 1):
        own = [environment(m, i, r) or "" for i in range(n)]
        for i in range(n):
            for j in range(i + 1, n):
                if d[i, j] < 1e8:
                    one, two = sorted((own[i], own[j]))
                    out.append(f"{one}|{int(d[i, j])}|{two}")
    if not duplicates:
        return sorted(set(out))
    seen: dict[str, int] = {}
    for k, x in enumerate(out):
        seen[x] = seen.get(x, 0) + 1
        out[k] = x if seen[x] == 1 else f"{x}|{seen[x]}"
    return sorted(out)


SHINGLES = {"circular": circular_shingles, "pairs": pair_shingles}


def shingles(df: DataFrame, id_col: str, smiles: str, kind: str = "circular", errors: str = "raise", **options) -> DataFrame:
    """(id, shingles array<string>) of each molecule."""
    make = SHINGLES[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(by_text(b, 1, lambda m: make(m, **options), errors), pa.list_(pa.string()))], [id_col, "shingles"])

    return df.select(id_col, smiles).mapInArrow(run, T.StructType([df.schema[id_col], T.StructField("shingles", T.ArrayType(T.StringType()))]))


def canonical(df: DataFrame, id_col: str, smiles: str, out: str = "smiles", errors: str = "raise") -> DataFrame:
    """(id, out): each molecule written anew, so equal graphs have equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(by_text(b, 1, to_smiles, errors), pa.string())], [id_col, out])

    return df.select(id_col, smiles).mapInArrow(run, T.StructType([df.schema[id_col], T.StructField(out, T.StringType())]))


def shingle_hash(shingle: Column) -> Column:
    """The first four bytes of SHA-1, little-endian."""
    s = F.sha1(shingle.cast("binary"))
    return F.conv(F.concat(F.substring(s, 7, 2), F.substring(s, 5, 2), F.substring(s, 3, 2), F.substring(s, 1, 2)), 16, 10).cast("bigint")


def folded_circular(df: DataFrame, id_col: str, smiles: str, fp_size: int = 2048, **options) -> DataFrame:
    """(id, bit): circular shingles by their hashes modulo ``fp_size``."""
    made = shingles(df, id_col, smiles, "circular", **options).select(id_col, F.explode("shingles").alias("s"))
    return made.select(id_col, F.pmod(shingle_hash(F.col("s")), F.lit(fp_size)).cast("int").alias("bit")).distinct()


#: Permutations are (a x + b) modulo this prime; a and b come from SHA-1 of the slot's number.
PRIME = (1 << 31) - 1


def _seed(name: str, slot: int) -> int:
    return int.from_bytes(hashlib.sha1(f"{name}{slot}".encode()).digest()[:4], "little") % (PRIME - 1) + 1


def _least(names: list[str], factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray | None:
    """For each permutation the least value over the shingles; None without shingles."""
    if not names:
        return None
    x = np.array([int.from_bytes(hashlib.sha1(n.encode()).digest()[:4], "little") % PRIME for n in names], np.int64)
    return ((factors[0][:, None] * x + factors[1][:, None]) % PRIME).min(1)  # below 2**62 before


def minhash_circular(df: DataFrame, id_col: str, smiles: str, size: int = 128, errors: str = "raise", **options) -> DataFrame:
    """(id, slot, value): MinHash of circular shingles, for each slot the least permuted hash.

    The permutations are the same everywhere and need no table. A molecule without shingles has no row.
    Only the different texts of an id are shuffled; all slots of a molecule are made where its text is.
    """
    texts = df.groupBy(id_col).agg(F.collect_set(F.struct(F.col(smiles).alias("s"))).alias("texts"))  # a null stays in its struct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(4096)
        factors = tuple(np.array([_seed(name, k) for k in range(size)], np.int64) for name in "ab")

        def made(text: str | None) -> np.ndarray | None:
            try:
                return _least(circular_shingles(molecule(text or ""), **options), factors)
            except SmilesError:
                if errors == "raise":
                    raise
                return None

        for b in batches:
            at, rows = [], []
            for i, held in enumerate(b.column(1).to_pylist()):
                found = [v for t in held if (v := known.get(t["s"], made)) is not None]
                if found:
                    at.append(i)
                    rows.append(found[0] if len(found) == 1 else np.minimum.reduce(found))
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            slots = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), slots], [id_col, "slots"])

    schema = T.StructType([df.schema[id_col], T.StructField("slots", T.ArrayType(T.LongType()))])
    return texts.mapInArrow(run, schema).select(id_col, F.posexplode("slots").alias("slot", "value"))
