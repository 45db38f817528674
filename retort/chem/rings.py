"""Rings of a molecule, aromaticity of rings written with single and double bonds, and explicit hydrogens."""

from __future__ import annotations

from itertools import combinations

from ..memo import Memo
from .smiles import Molecule, parse

#: Elements that pull the electron of a double bond out of a ring.
PULLING = ("N", "O", "S", "Se", "Te", "F")
#: Elements that can be aromatic, of rings of so many atoms at most, fused so many at once.
CAN_BE = ("B", "C", "N", "O", "P", "S", "As", "Se", "Te")
LARGEST, FUSED = 24, 3
_MOLECULES = Memo(4096)


def molecule(text: str) -> Molecule:
    """The molecule with its rings, the aromatic ones marked however they are written; not to be changed."""
    return _MOLECULES.get(text, _perceived)


def _perceived(text: str) -> Molecule:
    m = parse(text)
    m.rings = smallest_rings(m)
    aromatise(m, m.rings)
    return m


def _tree(near: list[list[int]], start: int) -> tuple[dict[int, int], dict[int, int]]:
    """Steps from ``start`` and the atom before, for all atoms that hang together with it."""
    steps, before, front = {start: 0}, {start: -1}, [start]
    while front:
        following = []
        for a in front:
            for b in near[a]:
                if b not in steps:
                    steps[b], before[b] = steps[a] + 1, a
                    following.append(b)
        front = following
    return steps, before


def cyclic_bonds(m: Molecule) -> set[frozenset[int]]:
    """Bonds in some ring: those that stay when atoms with one bond, then bridges, are cut."""
    near: list[list[int]] = [[] for _ in m.symbols]
    for i, j, _ in m.bonds:
        near[i].append(j)
        near[j].append(i)
    found, number, low, out = [-1] * len(near), 0, [0] * len(near), set()
    for root in range(len(near)):
        if found[root] >= 0:
            continue
        stack = [(root, -1, iter(near[root]))]
        found[root] = low[root] = number
        number += 1
        while stack:
            a, parent, rest = stack[-1]
            for b in rest:
                if b == parent:
                    continue
                if found[b] < 0:
                    found[b] = low[b] = number
                    number += 1
                    stack.append((b, a, iter(near[b])))
                    break
                low[a] = min(low[a], found[b])
            else:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[a])
                    if low[a] > found[parent]:
                        out.add(frozenset((a, parent)))  # a bridge
    return {frozenset((i, j)) for i, j, _ in m.bonds} - out


def smallest_rings(m: Molecule) -> list[tuple[int, ...]]:
    """A smallest set of smallest rings, each as its atoms in order around it.

    Candidates are the shortest ways from an atom to both ends of a bond; the shortest independent
    ones (over sums of bonds modulo two) are taken.
    """
    cyclic = cyclic_bonds(m)
    if not cyclic:
        return []
    bit = {b: 1 << k for k, b in enumerate(sorted(cyclic, key=sorted))}
    atoms = sorted({a for b in cyclic for a in b})
    near: list[list[int]] = [[] for _ in m.symbols]
    for b in bit:
        i, j = sorted(b)
        near[i].append(j)
        near[j].append(i)
    candidates: dict[int, tuple[int, ...]] = {}
    for v in atoms:
        steps, before = _tree(near, v)
        for b in bit:
            x, y = sorted(b)
            if x not in steps or abs(steps[x] - steps[y]) > 1 or before[x] == y or before[y] == x:
                continue
            ways = []
            for a in (x, y):
                way = [a]
                while before[way[-1]] >= 0:
                    way.append(before[way[-1]])
                ways.append(way)
            left, right = ways
            if set(left) & set(right) != {v}:
                continue
            ring = tuple(reversed(left)) + tuple(right[:-1])
            key = 0
            for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
                key |= bit[frozenset((p, q))]
            candidates.setdefault(key, ring)
    parts = 0
    seen: set[int] = set()
    for v in atoms:
        if v not in seen:
            parts += 1
            seen |= set(_tree(near, v)[0])
    wanted, basis, out = len(cyclic) - len(atoms) + parts, {}, []
    for key, ring in sorted(candidates.items(), key=lambda c: (len(c[1]), sorted(c[1]))):
        left_over = key
        while left_over:
            top = left_over.bit_length()
            if top not in basis:
                basis[top] = left_over
                out.append(ring)
                break
            left_over ^= basis[top]
        if len(out) == wanted:
            break
    return out


def _electrons(m: Molecule, i: int, ring_atoms: set[int], near: list[list[tuple[int, float]]]) -> int | None:
    """What atom ``i`` gives to a ring's cloud, or None if it cannot take part."""
    s, q = m.symbols[i], m.charges[i]
    degree = len(near[i]) + m.hydrogens[i]
    if s not in CAN_BE or degree > 3:
        return None
    if m.aromatic[i]:
        if s in ("O", "S", "Se", "Te"):
            return 2 if q == 0 else 1
        return 2 if s in ("N", "P", "As") and degree == 3 and q == 0 else 1
    double = [j for j, o in near[i] if o == 2]
    if len(double) > 1 or any(o > 2 for _, o in near[i]):
        return None
    if double:
        if double[0] in ring_atoms:
            return 1
        return 0 if s == "C" and m.symbols[double[0]] in PULLING else None
    if s in ("N", "P", "As"):
        return 2 if q == 0 and degree == 3 or q == -1 and degree == 2 else None
    if s in ("O", "S", "Se", "Te"):
        return 2 if q == 0 and degree == 2 else None
    if s == "C":
        return 2 if q == -1 else 0 if q == 1 else None
    return 0 if s == "B" and degree == 3 else None


def aromatise(m: Molecule, rings: list[tuple[int, ...]]) -> None:
    """Marks rings and fused groups of up to FUSED rings with 4n + 2 electrons as aromatic, in place."""
    near = m.neighbours
    plain = [r for r in rings if len(r) <= LARGEST]
    in_rings = {a for r in plain for a in r}
    gives = {a: _electrons(m, a, in_rings, near) for a in in_rings}
    ready = [r for r in plain if all(gives[a] is not None for a in r)]
    edges = [{frozenset(e) for e in zip(r, r[1:] + r[:1], strict=True)} for r in ready]
    marked: set[int] = set()
    bonds: set[frozenset[int]] = set()
    for size in range(1, FUSED + 1):
        for group in combinations(range(len(ready)), size):
            if size > 1 and (set(group) <= marked or not _fused(group, edges)):
                continue
            times: dict[frozenset[int], int] = {}
            for k in group:
                for e in edges[k]:
                    times[e] = times.get(e, 0) + 1
            rim = {e for e, n in times.items() if n == 1}
            total = sum(gives[a] for a in {a for e in rim for a in e})
            if total >= 2 and total % 4 == 2:
                marked |= set(group)
                bonds |= rim
                if all(any(k == j for j in marked) for k in group):
                    bonds |= {e for e in times if all(gives[a] == 1 for a in e)}
    atoms = {a for e in bonds for a in e}
    for a in atoms:
        m.aromatic[a] = True
    m.bonds = [(i, j, 1.5 if frozenset((i, j)) in bonds else o) for i, j, o in m.bonds]


def _fused(group: tuple[int, ...], edges: list[set[frozenset[int]]]) -> bool:
    """Whether the rings hang together by common bonds."""
    reached, todo = {group[0]}, [group[0]]
    while todo:
        a = todo.pop()
        for b in group:
            if b not in reached and edges[a] & edges[b]:
                reached.add(b)
                todo.append(b)
    return len(reached) == len(group)


def with_hydrogens(m: Molecule) -> Molecule:
    """A copy whose hydrogens are atoms of their own, after the others."""
    out = Molecule([*m.symbols], [*m.charges], [0] * len(m.symbols), [*m.aromatic], [*m.bonds], [*m.isotopes], [*m.chiral])
    for i, n in enumerate(m.hydrogens):
        for _ in range(n):
            out.bonds.append((i, len(out.symbols), 1.0))
            out.symbols.append("H")
            for column, value in ((out.charges, 0), (out.hydrogens, 0), (out.aromatic, False), (out.isotopes, 0), (out.chiral, "")):
                column.append(value)
    return out
