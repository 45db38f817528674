"""Fingerprints of what atoms do rather than what they are: feature pairs and triples, fuzzy pairs, property pairs."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np

from . import descriptors as D
from . import properties as P
from .fingerprints import KINDS, features, number
from .smarts import pattern
from .smiles import Molecule

# Property classes of atoms, tried in this order; what fits none is "other".
PROPERTY_CLASSES = (
    ("cation", "[+1,+2,+3,$([NX3;H2,H1,H0;!$(N-*=[O,N,S,P]);!$(N-a);!$(N#*);!$(N=*)]),$([NX3]-C(=[NX2])-[NX3])]"),
    ("anion", "[-1,-2,$([OX2H1]-C=O),$([OX1]=C-[OX2H1]),$([OX2H1]-[S,P]=O),$([OX1]=[S,P]-[OX2H1])]"),
    ("both", "[$([OX2H1]),$([NX3;H1,H2]-*=[O,N,S,P]),$([nH])]"),
    ("acceptor", "[$([OX1]=*),$([OX2H0]),$([o]),$([n;H0;X2]),$([NX1]#*),$([NX2]=*)]"),
    ("polar", "[$([#7,#8,#16;!H0]),$([C]=[O,N,S]),$([C]#N)]"),
    ("hydrophobe", "[$([C;!$(C~[#7,#8])]),$([c;!$(c~[#7,#8])]),Cl,Br,I,$([SX2H0]),s]"),
)
#: Features of fuzzy pairs: donor, acceptor, positive, negative, aromatic, hydrophobic end.
PAIR_FEATURES = ("[$([N;!H0;v3]),$([N;!H0;+1;v4]),$([O,S;H1;+0]),$([n;H1;+0])]", "[$([O,S;H0;v2]),$([O,S;-]),$([N;v3;H0;!$(N-*=[O,N,P,S])]),$([nH0;+0])]", "[+1,+2,$([NX3;H2;!$(N-*=*);!$(N-a)])]", "[-1,-2,$([C,S](=O)-[OH])]", "[a]", "[$([CD1;H3]),$([CD3;H1]([CD1])[CD1]),Cl,Br,I]")


def property_types(m: Molecule) -> list[str]:
    view = P.view_of(m)
    tests = [(name, pattern(t).atoms[0]) for name, t in PROPERTY_CLASSES]
    return [next((name for name, t in tests if t(view, i)), "other") for i in range(len(m.symbols))]


def property_pairs(m: Molecule, least: int = 1, most: int = 30, torsions: bool = False) -> Counter:
    """Pairs of property classes with the bonds between them, or runs of four bonded atoms' classes."""
    own = property_types(m)
    if torsions:
        near, out = m.neighbours, Counter()
        for i, j, _ in m.bonds:
            for a, _ in near[i]:
                for b, _ in near[j]:
                    if a != j and b != i and a != b:
                        run = [own[a], own[i], own[j], own[b]]
                        out[number(min(run, run[::-1]))] += 1
        return out
    d, n = D.distances(m), len(own)
    return Counter(number(*sorted((own[i], own[j])), int(d[i, j])) for i in range(n) for j in range(i + 1, n) if least <= d[i, j] <= most)


#: Upper edges of distance bins.
BINS = (2, 5, 8)


def feature_sets(m: Molecule, least_points: int = 2, most_points: int = 3) -> Counter:
    """Pairs and triples of atoms' features with binned distances; pairs beyond the last bin are left out."""
    if not 2 <= least_points <= most_points <= 3:
        raise ValueError("points must be 2 or 3")
    d, bits = D.distances(m), features(m)
    spots = [(i, k) for i, x in enumerate(bits) for k in range(6) if x >> k & 1]
    place = lambda i, j: int(np.searchsorted(BINS, d[i, j]))
    out: Counter = Counter()
    close = {(a, b) for a, b in combinations(range(len(spots)), 2) if spots[a][0] != spots[b][0] and d[spots[a][0], spots[b][0]] <= BINS[-1]}
    if least_points == 2:
        for a, b in close:
            out[number(2, *sorted((spots[a][1], spots[b][1])), place(spots[a][0], spots[b][0]))] += 1
    if most_points == 3:
        after: dict[int, set[int]] = {}
        for a, b in close:
            after.setdefault(a, set()).add(b)
        for a, b in close:
            for c in after.get(a, set()) & after.get(b, set()):
                corners = sorted(((spots[x][1], place(spots[y][0], spots[z][0])) for x, y, z in ((a, b, c), (b, a, c), (c, a, b))))
                out[number(3, *corners)] += 1
    return out


def fuzzy_pairs(m: Molecule, fuzz: float = 0.3, least: int = 1, most: int = 15) -> list[float]:
    """For each of the 21 pairs of PAIR_FEATURES and each distance from 1 to ``most`` bonds how many
    atoms stand so, with ``fuzz`` added one bond nearer and farther: 21 * most numbers."""
    view, d = P.view_of(m), D.distances(m)
    held = [[i for i in range(len(m.symbols)) if t(view, i)] for t in (pattern(x).atoms[0] for x in PAIR_FEATURES)]
    out = np.zeros((21, most + 2))
    for row, (p, q) in enumerate((p, q) for p in range(6) for q in range(p, 6)):
        for i in held[p]:
            for j in held[q]:
                if i != j and (p != q or i < j) and least <= d[i, j] <= most:
                    k = int(d[i, j])
                    out[row, k] += 1
                    out[row, k - 1] += fuzz
                    out[row, k + 1] += fuzz
    return [float(x) for x in out[:, 1 : most + 1].ravel()]


def screening_paths(m: Molecule, bonds: int = 4) -> Counter:
    """Element paths of up to ``bonds`` bonds: those of a part of a molecule are among the molecule's."""
    out: Counter = Counter(number(s) for s in m.symbols)
    todo = [(i,) for i in range(len(m.symbols))]
    near = m.neighbours
    while todo:
        w = todo.pop()
        if len(w) > 1 and w[0] < w[-1]:
            run = [m.symbols[a] for a in w]
            out[number(min(run, run[::-1]))] += 1
        if len(w) <= bonds:
            todo += [(*w, j) for j, _ in near[w[-1]] if j not in w]
    return out


KINDS |= {"property_pairs": property_pairs, "feature_sets": feature_sets, "screening": screening_paths}
