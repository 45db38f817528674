"""Numeric fingerprints of a molecule's graph: electrotopological states, quantum numbers, charges, autocorrelation, Burden eigenvalues."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import descriptors as D
from . import properties as P
from . import rings as R
from .smarts import pattern
from .smiles import WEIGHTS, Molecule
from .substructure import by_text
from .tables import ATOM_TYPES

# Mass, van der Waals volume, electronegativity, polarisability and ionisation potential beside carbon's.
ELEMENT_WEIGHTS = {
    "H": (0.084, 0.299, 0.944, 0.379, 1.208), "B": (0.900, 0.796, 0.828, 1.722, 0.737), "C": (1.0, 1.0, 1.0, 1.0, 1.0), "N": (1.166, 0.695, 1.163, 0.625, 1.291),
    "O": (1.332, 0.512, 1.331, 0.456, 1.209), "F": (1.582, 0.410, 1.457, 0.296, 1.547), "Si": (2.339, 1.424, 0.779, 3.057, 0.724), "P": (2.579, 1.181, 0.916, 2.063, 0.931),
    "S": (2.670, 1.088, 1.077, 1.648, 0.920), "Cl": (2.952, 1.035, 1.265, 1.239, 1.152), "Br": (6.653, 1.384, 1.172, 1.733, 1.049), "I": (10.566, 1.728, 1.012, 3.040, 0.928),
}
# Outer electrons and row of the elements that states are defined for.
OUTER = {
    "Li": (1, 2), "Be": (2, 2), "B": (3, 2), "C": (4, 2), "N": (5, 2), "O": (6, 2), "F": (7, 2), "Na": (1, 3), "Mg": (2, 3), "Al": (3, 3), "Si": (4, 3), "P": (5, 3), "S": (6, 3),
    "Cl": (7, 3), "Ge": (4, 4), "As": (5, 4), "Se": (6, 4), "Br": (7, 4), "Sn": (4, 5), "Pb": (4, 6), "Te": (6, 5), "I": (7, 5),
}
# Electronegativity by charge (start, slope, curvature) of an atom by element and hybridisation.
EQUALISATION = {
    ("H", 0): (7.17, 6.24, -0.56), ("C", 3): (7.98, 9.18, 1.88), ("C", 2): (8.79, 9.32, 1.51), ("C", 1): (10.39, 9.45, 0.73), ("N", 3): (11.54, 10.82, 1.36), ("N", 2): (12.87, 11.15, 0.85),
    ("N", 1): (15.68, 11.70, -0.27), ("O", 3): (14.18, 12.92, 1.39), ("O", 2): (17.07, 13.79, 0.47), ("F", 3): (14.66, 13.85, 2.31), ("Cl", 3): (11.00, 9.69, 1.35), ("Br", 3): (10.08, 8.47, 1.16),
    ("I", 3): (9.90, 7.96, 0.96), ("S", 3): (10.14, 9.13, 1.38), ("P", 3): (8.90, 8.24, 0.96),
}
HYDROGEN_ION = 20.02


def _series(symbol: str) -> list[str]:
    """States of an element of carbon's group with single bonds only."""
    return [f"[{symbol};D1;H3]-*", f"[{symbol};D2;H2](-*)-*", f"[{symbol};D3;H1](-*)(-*)-*", f"[{symbol};D4;H0](-*)(-*)(-*)-*"]


def _pnictogen(symbol: str) -> list[str]:
    return [f"[{symbol};D1;H2]-*", f"[{symbol};D2;H1](-*)-*", f"[{symbol};D3;H0](-*)(-*)-*", f"[{symbol};D4;H0](=*)(-*)(-*)-*", f"[{symbol};D5;H0](-*)(-*)(-*)(-*)-*"]


def _chalcogen(symbol: str) -> list[str]:
    low = symbol.lower()
    return [f"[{symbol};D1;H1]-*", f"[{symbol};D1;H0]=*", f"[{symbol};D2;H0](-*)-*", f"[{symbol},{low};D2;H0](:*):*", f"[{symbol};D3;H0](=*)(-*)-*", f"[{symbol};D4;H0](=*)(=*)(-*)-*"]


#: The 79 atom types of the electrotopological state in their usual order; series are written by rule.
STATE_TYPES: tuple[str, ...] = (
    "[Li;D1]-*", "[Be;D2](-*)-*", "[Be;D4](-*)(-*)(-*)-*", "[B;D2;H1](-*)-*", "[B;D3](-*)(-*)-*", "[B;D4](-*)(-*)(-*)-*",
    "[C;D1;H3]-*", "[C;D1;H2]=*", "[C;D2;H2](-*)-*", "[C;D1;H1]#*", "[C;D2;H1](=*)-*", "[C,c;D2;H1](:*):*", "[C;D3;H1](-*)(-*)-*", "[C;D2;H0](=*)=*", "[C;D2;H0](#*)-*", "[C;D3;H0](=*)(-*)-*",
    "[C,c;D3;H0](:*)(:*)-*", "[C,c;D3;H0](:*)(:*):*", "[C;D4;H0](-*)(-*)(-*)-*",
    "[N;D1;H3]-*", "[N;D1;H2]-*", "[N;D2;H2](-*)-*", "[N;D1;H1]=*", "[N;D2;H1](-*)-*", "[N,n;D2;H1](:*):*", "[N;D1;H0]#*", "[N;D3;H1](-*)(-*)-*", "[N;D2;H0](=*)-*", "[N,n;D2;H0](:*):*",
    "[N;D3;H0](-*)(-*)-*", "[N;D3;H0](~[O;D1;H0])(~[O;D1;H0])-,:*", "[N,n;D3;H0](:*)(:*)-,:*", "[N;D4;H0](-*)(-*)(-*)-*",
    "[O;D1;H1]-*", "[O;D1;H0]=*", "[O;D2;H0](-*)-*", "[O,o;D2;H0](:*):*", "[F;D1]-*",
    *_series("Si"), *_pnictogen("P"), *_chalcogen("S"), "[Cl;D1]-*", *_series("Ge"), *_pnictogen("As"), *_chalcogen("Se"), "[Br;D1]-*", *_series("Sn"), "[I;D1]-*", *_series("Pb"),
)


def intrinsic_states(m: Molecule) -> np.ndarray:
    """((2 / row)^2 (outer electrons - hydrogens) + 1) / bonds of each atom; 0 without bonds."""
    out = np.zeros(len(m.symbols))
    for i, near in enumerate(m.neighbours):
        if near and m.symbols[i] in OUTER:
            outer, row = OUTER[m.symbols[i]]
            out[i] = ((2 / row) ** 2 * (outer - m.hydrogens[i]) + 1) / len(near)
    return out


def states(m: Molecule) -> np.ndarray:
    """Intrinsic states and what all other atoms do to them by the square of distance."""
    own, d = intrinsic_states(m), D.distances(m)
    far = np.where(d < 1e8, (d + 1.0) ** 2, np.inf)
    return own + ((own[:, None] - own[None, :]) / far).sum(1)


def state_sums(m: Molecule, variant: str = "sum") -> list[float]:
    """For each of STATE_TYPES the sum of its atoms' states (``sum``), their number (``count``) or whether there is one (``bit``)."""
    if variant not in ("sum", "count", "bit"):
        raise ValueError("variant must be sum, count or bit")
    view, value = P.view_of(m), states(m)
    out = []
    for text in STATE_TYPES:
        p = pattern(text)
        found = [i for i in range(len(m.symbols)) if p.atoms[0](view, i) and next(p.places(view, i), None) is not None]
        out.append(float(value[found].sum()) if variant == "sum" else float(len(found) if variant == "count" else bool(found)))
    return out


def quantum_numbers(m: Molecule) -> list[int]:
    """The 42 molecular quantum numbers: atoms, bonds, polarity and topology.

    Aromatic bonds count as single and double in turns; an acceptor oxygen or sulphur has two sites.
    """
    view, rings = P.view_of(m), m.rings
    cyclic = [bool(s) for s in view.ring_sizes]
    of = lambda s: sum(x == s for x in m.symbols)
    heavy = [i for i, s in enumerate(m.symbols) if s != "H"]
    nodes = lambda ring, degree: sum(cyclic[i] == ring and sum(m.symbols[j] != "H" for j in view.near[i]) == degree for i in heavy)
    bonds = {(ring, order): 0 for ring in (False, True) for order in (1, 2, 3)}
    flat = 0
    for i, j, o in m.bonds:
        if o == 1.5:
            flat += 1
        elif o in (1, 2, 3):
            bonds[frozenset((i, j)) in view.cyclic, int(o)] += 1
    acceptors = [p[0] for p in pattern(P.ACCEPTOR).matches(view)]
    donors = [p[0] for p in pattern(P.DONOR).matches(view)]
    sizes = [len(r) for r in rings]
    edges = [{frozenset(e) for e in zip(r, r[1:] + r[:1], strict=True)} for r in rings]
    atoms_shared = {a for k, r in enumerate(rings) for q in rings[k + 1 :] for a in set(r) & set(q)}
    bonds_shared = {e for k, r in enumerate(edges) for q in edges[k + 1 :] for e in r & q}
    return [
        of("C"), of("F"), of("Cl"), of("Br"), of("I"), of("S"), of("P"),
        *(sum(s == x and cyclic[i] == ring for i, s in enumerate(m.symbols)) for x in ("N", "O") for ring in (False, True)), len(heavy),
        bonds[False, 1], bonds[False, 2], bonds[False, 3], bonds[True, 1] + (flat + 1) // 2, bonds[True, 2] + flat // 2, bonds[True, 3], P.rotatable_bonds(m),
        sum(2 if m.symbols[i] in ("O", "S") else 1 for i in acceptors), len(acceptors), sum(view.all_h[i] for i in donors), len(donors), sum(q < 0 for q in m.charges), sum(q > 0 for q in m.charges),
        *(nodes(False, k) for k in (1, 2, 3, 4)), *(nodes(True, k) for k in (2, 3, 4)), *(sizes.count(k) for k in range(3, 10)), sum(k > 9 for k in sizes), len(atoms_shared), len(bonds_shared),
    ]


def partial_charges(m: Molecule, model: str = "formal", steps: int = 12) -> list[float]:
    """Charges of the atoms: ``formal``, or ``gasteiger`` by partial equalisation of electronegativity
    over the bonds, each step half as strong; hydrogens' shares are on the hydrogens.
    An element without numbers raises ValueError."""
    if model == "formal":
        return [float(q) for q in m.charges]
    if model != "gasteiger":
        raise ValueError("model must be formal or gasteiger")
    full = R.with_hydrogens(m)
    kinds = P.hybridisation(m) + [0] * (len(full.symbols) - len(m.symbols))
    numbers = []
    for s, k in zip(full.symbols, kinds, strict=True):
        key = (s, 0 if s == "H" else k)
        given = EQUALISATION.get(key) or EQUALISATION.get((s, 3))
        if given is None:
            raise ValueError(f"no charge parameters for {s}")
        numbers.append(given)
    a, b, c = np.array(numbers).T
    ion = np.where(np.array(full.symbols) == "H", HYDROGEN_ION, a + b + c)
    q, part = np.array(full.charges, float), 0.5
    for _ in range(steps):
        pull = a + b * q + c * q * q
        for i, j, _ in full.bonds:
            low, high = (i, j) if pull[i] < pull[j] else (j, i)
            move = part * (pull[high] - pull[low]) / ion[low]
            q[low] += move
            q[high] -= move
        part /= 2
    return q[: len(m.symbols)].tolist()


def burden_eigenvalues(m: Molecule, model: str = "formal") -> list[float]:
    """Largest and smallest eigenvalue of the Burden matrix with mass, charge, partition and
    refractivity of the atoms on its diagonal: eight numbers."""
    types = P.atom_types(m)[: len(m.symbols)]
    diagonals = [[WEIGHTS.get(s, 0.0) for s in m.symbols], partial_charges(m, model), *([ATOM_TYPES[k][c] if k >= 0 else 0.0 for k in types] for c in (1, 2))]
    out = []
    for diagonal in diagonals:
        v = np.linalg.eigvalsh(D.burden_matrix(m, diagonal))
        out += [float(v[-1]), float(v[0])]
    return out


def atom_weights(symbols: list[str]) -> np.ndarray:
    """A row for each of the five element weights; elements without numbers weigh like carbon."""
    return np.array([ELEMENT_WEIGHTS.get(s, ELEMENT_WEIGHTS["C"]) for s in symbols]).T.reshape(5, len(symbols))


def autocorrelation(m: Molecule, lags: int = 8) -> list[float]:
    """Moreau-Broto, centered Moreau-Broto, Moran and Geary autocorrelation at 1 to ``lags`` bonds over
    all atoms with hydrogens, for mass, volume, electronegativity, polarisability, ionisation and
    intrinsic state: 4 x 6 x lags numbers."""
    full = R.with_hydrogens(m)
    d = D.distances(full)
    weights = np.vstack([atom_weights(full.symbols), intrinsic_states(full)])
    blocks: list[list[float]] = [[], [], [], []]
    n = len(full.symbols)
    for w in weights:
        centered = w - w.mean()
        spread = float((centered**2).sum())
        for lag in range(1, lags + 1):
            i, j = np.nonzero(np.triu(d == lag, 1))
            pairs = len(i)
            plain, middle = float((w[i] * w[j]).sum()), float((centered[i] * centered[j]).sum())
            gap = float(((w[i] - w[j]) ** 2).sum())
            blocks[0].append(float(np.log1p(abs(plain))))
            blocks[1].append(float(np.log1p(abs(middle))))
            blocks[2].append(middle / pairs / (spread / n) if pairs and spread > 1e-12 else 0.0)
            blocks[3].append(gap / (2 * pairs) / (spread / (n - 1)) if pairs and spread > 1e-12 and n > 1 else 0.0)
    return [x for b in blocks for x in b]


# Bonding radii, by how much bonds of an order shorten, and the upper edges of the bins.
RADII = {"H": 0.33, "B": 0.88, "C": 0.77, "N": 0.70, "O": 0.66, "F": 0.619, "Si": 1.17, "P": 1.07, "S": 1.04, "Cl": 0.997, "Se": 1.17, "Br": 1.14, "I": 1.33}
SHORTER = {1.5: 0.1, 1.0: 0.0, 2.0: 0.2, 3.0: 0.3}
SURFACE_BINS = {
    "logp": (-0.4, -0.2, 0.0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6),
    "refractivity": (1.29, 1.82, 2.24, 2.45, 2.75, 3.05, 3.63, 3.8, 4.0),
    "charge": (-0.3, -0.25, -0.2, -0.15, -0.1, -0.05, 0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3),
    "state": (-0.39, 0.29, 0.717, 1.165, 1.54, 1.807, 2.05, 4.69, 9.17, 15.0),
}


def atom_surfaces(m: Molecule) -> np.ndarray:
    """Labute's share of each atom in the surface of the molecule: its sphere less what its neighbours cover, one hydrogen among them."""
    radius = np.array([RADII.get(s, 0.77) for s in m.symbols])
    covered = np.zeros(len(radius))

    def cover(i: float, j: float, shorter: float) -> float:
        d = min(max(abs(i - j), i + j - shorter), i + j)
        return j * j - (i - d) ** 2 / d

    for i, j, o in m.bonds:
        covered[i] += cover(radius[i], radius[j], SHORTER.get(o, 0.0))
        covered[j] += cover(radius[j], radius[i], SHORTER.get(o, 0.0))
    covered += [cover(r, RADII["H"], 0.0) for r in radius]
    return 4 * np.pi * radius**2 - np.pi * radius * covered


def surface_bins(m: Molecule, kinds: tuple[str, ...] = ("logp", "refractivity", "charge", "state")) -> list[float]:
    """Surfaces of the atoms, summed in bins of a property: 12 numbers by partition, 10 by refractivity, 14 by charge, 11 by state."""
    surface, out = atom_surfaces(m), []
    for kind in kinds:
        if kind == "charge":
            value = np.array(partial_charges(m, "gasteiger"))
        elif kind == "state":
            value = states(m)
        else:
            column = 1 if kind == "logp" else 2
            value = np.array([ATOM_TYPES[k][column] if k >= 0 else 0.0 for k in P.atom_types(m)[: len(m.symbols)]])
        edges = SURFACE_BINS[kind]
        out += np.bincount(np.searchsorted(edges, value, side="right"), surface, len(edges) + 1).tolist()
    return out


def vector_descriptor(df: DataFrame, id_col: str, smiles: str, make: Callable[[Molecule], list], out: str = "vector", errors: str = "null") -> DataFrame:
    """(id, array<double>) of ``make(molecule)``; null for a text that is no SMILES, or an error with "raise"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = by_text(b, 1, lambda m: [float(x) for x in make(m)], errors)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], [id_col, out])

    return df.select(id_col, smiles).mapInArrow(run, T.StructType([df.schema[id_col], T.StructField(out, T.ArrayType(T.DoubleType()))]))
