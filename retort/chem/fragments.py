"""Similarity of a query's large fragments to a reference: what a fragment does not explain is masked in both."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame

from .common import pair_measure
from .fingerprints import number
from .rings import cyclic_bonds
from .smiles import Molecule


def fragments(m: Molecule, most_cuts: int = 2, least_share: float = 0.6) -> list[frozenset[int]]:
    """Connected parts left by cutting up to ``most_cuts`` single bonds outside rings, with at least that share of the atoms."""
    cyclic = cyclic_bonds(m)
    open_bonds = [k for k, (i, j, o) in enumerate(m.bonds) if o == 1 and frozenset((i, j)) not in cyclic]
    found: set[frozenset[int]] = set()
    for n in range(1, most_cuts + 1):
        for cut in combinations(open_bonds, n):
            near: list[list[int]] = [[] for _ in m.symbols]
            for k, (i, j, _) in enumerate(m.bonds):
                if k not in cut:
                    near[i].append(j)
                    near[j].append(i)
            left = set(range(len(m.symbols)))
            while left:
                todo, part = [left.pop()], set()
                while todo:
                    a = todo.pop()
                    if a not in part:
                        part.add(a)
                        todo += near[a]
                left -= part
                if len(part) >= least_share * len(m.symbols) and len(part) < len(m.symbols):
                    found.add(frozenset(part))
    return sorted(found, key=sorted)


def _walks(m: Molecule, held: frozenset[int], bonds: int) -> Iterator[tuple[int, ...]]:
    near = m.neighbours
    todo = [(i,) for i in sorted(held)]
    while todo:
        w = todo.pop()
        if w[0] <= w[-1]:
            yield w
        if len(w) <= bonds:
            todo += [(*w, j) for j, _ in near[w[-1]] if j in held and j not in w]


def path_features(m: Molecule, held: frozenset[int] | None = None, masked: frozenset[int] = frozenset(), bonds: int = 5) -> list[tuple[int, tuple[int, ...]]]:
    """(feature, atoms) of every path of up to ``bonds`` bonds; masked atoms are alike."""
    held = held if held is not None else frozenset(range(len(m.symbols)))
    order = {frozenset((i, j)): o for i, j, o in m.bonds}
    name = ["*" if i in masked else s.lower() if m.aromatic[i] else s for i, s in enumerate(m.symbols)]
    out = []
    for w in _walks(m, held, bonds):
        key = [name[w[0]]]
        for a, b in zip(w, w[1:], strict=False):
            key += [order[frozenset((a, b))], name[b]]
        out.append((number("path", min(repr(key), repr(key[::-1]))), w))
    return out


def _tanimoto(x: set[int], y: set[int]) -> float:
    return len(x & y) / len(x | y) if x | y else 1.0


def _unexplained(m: Molecule, features: list[tuple[int, tuple[int, ...]]], part: set[int], threshold: float) -> frozenset[int]:
    """Atoms of whose paths less than ``threshold`` are among the fragment's."""
    own: list[set[int]] = [set() for _ in m.symbols]
    for f, w in features:
        for a in w:
            own[a].add(f)
    return frozenset(i for i, x in enumerate(own) if len(x & part) < threshold * len(x))


def fragment_similarity(query: Molecule, reference: Molecule, threshold: float = 0.8) -> float:
    """The larger of the two molecules' path similarity and, over the query's fragments, that of both
    with masks on what the fragment does not explain. Not symmetric."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be 0 to 1")
    mine, theirs = path_features(query), path_features(reference)
    best = _tanimoto({f for f, _ in mine}, {f for f, _ in theirs})
    for part in fragments(query):
        inside = {f for f, _ in path_features(query, part)}
        hidden = _unexplained(reference, theirs, inside, threshold)
        if len(hidden) == len(reference.symbols):
            continue
        one = path_features(query, masked=frozenset(range(len(query.symbols))) - part)
        two = path_features(reference, masked=hidden)
        best = max(best, _tanimoto({f for f, _ in one}, {f for f, _ in two}))
    return best


def pair_fragment_similarity(pairs: DataFrame, query: str, reference: str, threshold: float = 0.8, errors: str = "raise") -> DataFrame:
    """``pairs`` with ``similarity`` and ``distance`` of a query's to a reference's SMILES column."""
    return pair_measure(pairs, query, reference, lambda a, b: fragment_similarity(a, b, threshold), errors)
