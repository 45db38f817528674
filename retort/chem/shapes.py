"""Fingerprints of a conformer's coordinates: moments of distances, radial and scattering functions, principal axes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import rings as R
from .descriptors import distances
from .fingerprints import number
from .properties import view_of
from .smarts import pattern
from .smiles import VALENCES, Molecule
from .vectors import atom_weights, intrinsic_states

# Atom classes beside all atoms: hydrophobic, aromatic, acceptor, donor.
CLASSES = (
    "[#6+0!$(*=,#[!#6])]",
    "[a]",
    "[$([O,S;H1;v2]-[!$(*=[O,N,P,S])]),$([O,S;H0;v2]),$([O,S;-]),$([N;v3;H1,H2]-[!$(*=[O,N,P,S])]),$([N;v3;H0]),$([n,o,s;+0]),F]",
    "[$([N;!H0;v3]),$([N;!H0;+;v4]),$([O;H1;+0]),$([S;H1;+0]),$([n;H1;+0])]",
)


def _far(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(1))


def _moments(distances: list[np.ndarray]) -> list[float]:
    """Mean, deviation and cube root of the third moment of each; zeros for none."""
    out = []
    for d in distances:
        out += [float(d.mean()), float(d.std()), float(np.cbrt(((d - d.mean()) ** 3).mean()))] if len(d) else [0.0] * 3
    return out


def landmarks(x: np.ndarray) -> list[np.ndarray]:
    """The center, the atoms nearest to and farthest from it, and the atom farthest from that one."""
    if len(x) < 3:
        raise ValueError("a shape needs three atoms")
    center = x.mean(0)
    far = _far(x, center)
    farthest = x[far.argmax()]
    return [center, x[far.argmin()], farthest, x[_far(x, farthest).argmax()]]


def shape(symbols: list[str], x: np.ndarray, bonds: list) -> list[float]:
    """Twelve moments of the distances to four landmarks."""
    return _moments([_far(x, p) for p in landmarks(x)])


def shape_by_class(symbols: list[str], x: np.ndarray, bonds: list) -> list[float]:
    """The twelve moments over all atoms, then over each of CLASSES, to the landmarks of all: sixty numbers."""
    m = graph(symbols, bonds)
    view, marks = view_of(m), landmarks(x)
    out = _moments([_far(x, p) for p in marks])
    for text in CLASSES:
        test = pattern(text).atoms[0]
        members = x[[i for i in range(len(symbols)) if test(view, i)]]
        out += _moments([_far(members, p) if len(members) else np.zeros(0) for p in marks])
    return out


def charged_shape(symbols: list[str], x: np.ndarray, bonds: list, charges: list[float] | None = None, scaling: float = 25.0) -> list[float]:
    """Fifteen moments of distances in space and scaled charge: to the center, the atom farthest from
    it, the atom farthest from that one, and two points off their plane, one at the highest charge
    and one at the lowest."""
    q = scaling * np.array(charges if charges is not None else [0.0] * len(x))
    points = np.column_stack([x, q])
    if len(points) < 3:
        raise ValueError("a shape needs three atoms")
    marks = [points.mean(0)]
    for _ in range(2):
        marks.append(points[_far(points, marks[-1]).argmax()])
    one, two = (p[:3] - marks[0][:3] for p in marks[1:])
    normal = np.cross(one, two)
    length = np.linalg.norm(normal)
    lift = normal / length * np.linalg.norm(marks[1] - marks[0]) / 2 if length else normal
    marks += [np.append(marks[0][:3] + lift, edge) for edge in (q.max(), q.min())]
    return _moments([_far(points, p) for p in marks])


def _weights(symbols: list[str], bonds: list) -> np.ndarray:
    """Ones, five element weights and intrinsic states of the atoms, in rows."""
    return np.vstack([np.ones(len(symbols)), atom_weights(symbols), intrinsic_states(graph(symbols, bonds))])


def _pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.triu_indices(len(x), 1)
    return i, j, np.sqrt(((x[i] - x[j]) ** 2).sum(1))


def radial(symbols: list[str], x: np.ndarray, bonds: list, sharpness: float = 100.0) -> list[float]:
    """Radial distribution at 1.0, 1.5 ... 15.5, plain, by five element weights and by states: sum over pairs of
    the product of weights times exp(-sharpness (R - r)^2)."""
    i, j, r = _pairs(x)
    at = np.arange(1.0, 16.0, 0.5)
    kernel = np.exp(-sharpness * (at[:, None] - r) ** 2)
    return [float(v) for w in _weights(symbols, bonds) for v in kernel @ (w[i] * w[j])]


def scattering(symbols: list[str], x: np.ndarray, bonds: list, points: int = 32) -> list[float]:
    """Electron diffraction at s = 0, 1 ...: sum over pairs of weights times sin(s r) / (s r), plain, by five element weights and by states."""
    i, j, r = _pairs(x)
    s = np.arange(points)
    kernel = np.sinc(s[:, None] * r / np.pi)
    return [float(v) for w in _weights(symbols, bonds) for v in kernel @ (w[i] * w[j])]


def principal(symbols: list[str], x: np.ndarray, bonds: list) -> list[float]:
    """For each weighting: the variances along the weighted principal axes, their shares, and the
    kurtosis-like spread along each, then sum, products and shape of the variances."""
    out = []
    for w in _weights(symbols, bonds)[:-1]:  # states may sum to 0
        center = (w[:, None] * x).sum(0) / w.sum()
        moved = x - center
        cov = (w[:, None] * moved).T @ moved / w.sum()
        values, axes = np.linalg.eigh(cov)
        values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
        along = moved @ axes
        total = float(values.sum())
        share = values / total if total else np.zeros(3)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.where(values > 1e-12, len(x) * values**2 / np.maximum((along**4).sum(0), 1e-300), 0.0)
        second = float(values[0] * values[1] + values[0] * values[2] + values[1] * values[2])
        out += [*values.tolist(), *share[:2].tolist(), *spread.tolist(), total, second, total + second + float(values.prod()), float(np.abs(share - 1 / 3).sum() / (4 / 3)), float(spread.sum())]
    return out


def spatial_autocorrelation(symbols: list[str], x: np.ndarray, bonds: list, lags: int = 10) -> list[float]:
    """Mean over pairs at 1 to ``lags`` bonds of the product of weights and the distance in space, plain, by five element weights and by states."""
    steps = distances(graph(symbols, bonds))
    i, j, r = _pairs(x)
    at = steps[i, j]
    out = []
    for w in _weights(symbols, bonds):
        for lag in range(1, lags + 1):
            near = at == lag
            out.append(float((w[i] * w[j] * r)[near].mean()) if near.any() else 0.0)
    return out


def influences(symbols: list[str], x: np.ndarray, bonds: list, lags: int = 8) -> np.ndarray:
    """``influence`` of many conformers of one molecule, places (conformer, atom, axis), in a row each."""
    n, out = len(symbols), []
    centered = x - x.mean(1, keepdims=True)
    h = centered @ np.linalg.pinv(centered.transpose(0, 2, 1) @ centered) @ centered.transpose(0, 2, 1)
    lever = np.clip(np.diagonal(h, axis1=1, axis2=2), 0, None)
    m = graph(symbols, bonds)
    steps = distances(m)
    r = np.sqrt(((x[:, :, None] - x[:, None]) ** 2).sum(-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        tied = np.where(r > 1e-9, np.sqrt(lever[:, :, None] * lever[:, None]) / r, 0.0)
        total = lever.sum(1, keepdims=True)
        share = np.where(total > 0, lever / total, lever)
    near = np.round(lever, 4)
    times = (near[:, :, None] == near[:, None]).sum(2) / n  # an atom's part of the sum over different values is 1 / n
    entropy = -np.log2(times).sum(1) / n
    heavy = [i for i, s in enumerate(symbols) if s != "H"]
    held = lever[:, heavy] if heavy else lever
    parts = np.where(share > 0, share * np.log2(np.where(share > 0, share, 1.0)), 0.0)
    strength = tied.sum(2)
    i, j = np.nonzero(np.triu(steps == 1, 1))
    out += [n * entropy, entropy / np.log2(n) if n > 1 else 0 * entropy, -parts.sum(1), 100 * np.exp(np.log(np.maximum(held, 1e-12)).mean(1)), np.sqrt(strength[:, i] * strength[:, j]).sum(1), strength.mean(1), np.linalg.eigvalsh(tied)[:, -1]]
    weights = np.vstack([np.ones(n), atom_weights(symbols), intrinsic_states(m)])
    pairs = [np.nonzero(np.triu(steps == lag)) for lag in range(lags + 1)]
    shared = [(np.where(h[:, i, j] > 0, h[:, i, j], 0.0), lever[:, i] * lever[:, j], tied[:, i, j]) for i, j in pairs]
    for w in weights:
        blocks: list[list[np.ndarray]] = [[], [], [], []]
        for lag, ((i, j), (one, two, three)) in enumerate(zip(pairs, shared, strict=True)):
            both = w[i] * w[j]
            blocks[0].append((both * one).sum(1))
            blocks[1].append((both * two).sum(1))
            if lag:
                parts = both * three
                blocks[2].append(parts.sum(1))
                blocks[3].append(parts.max(1) if len(i) else np.zeros(len(x)))
        out += [*blocks[0], blocks[0][0] + 2 * sum(blocks[0][1:]), *blocks[1], blocks[1][0] + 2 * sum(blocks[1][1:]), *blocks[2], 2 * sum(blocks[2]), *blocks[3], np.maximum.reduce(blocks[3])]
    return np.column_stack(out)


def influence(symbols: list[str], x: np.ndarray, bonds: list, lags: int = 8) -> list[float]:
    """Descriptors of the influence matrix H of the centered coordinates and of the matrix R of
    sqrt(h_i h_j) / r: entropies, means and eigenvalues, then for each weighting autocorrelations of
    H's diagonal and of R by bonds between atoms, with their sums and greatest parts."""
    return influences(symbols, x[None], bonds, lags)[0].tolist()


def shells(symbols: list[str], x: np.ndarray, bonds: list, levels: int = 5, multiplier: float = 1.718, size: int = 1024) -> list[float]:
    """Counts of atoms' surroundings in spheres that grow by ``multiplier``: what an atom sees at a
    level is hashed with what those atoms saw at the level before; folded to ``size`` slots."""
    m = graph(symbols, bonds)
    tie = {frozenset((i, j)): o for i, j, o in m.bonds}
    now = [number("shell", s, len(near), m.hydrogens[i], m.aromatic[i]) for i, (s, near) in enumerate(zip(m.symbols, m.neighbours, strict=True))]
    r = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out, seen = np.zeros(size), set()
    for level in range(levels + 1):
        if level:
            inside = r <= multiplier * level
            cover = [frozenset(np.flatnonzero(row).tolist()) for row in inside]
            now = [number(level, now[i], sorted((tie.get(frozenset((i, j)), 0.0), now[j]) for j in cover[i] if j != i)) for i in range(len(now))]
            fresh = [n for c, n in sorted(zip(cover, now, strict=True), key=lambda p: p[1]) if c not in seen]
            seen |= set(cover)
        else:
            fresh = now
        for n in fresh:
            out[n % size] += 1
    return out.tolist()


def graph(symbols: list[str], bonds: list) -> Molecule:
    """The molecule of atoms and bonds (i, j, order) as they stand in a file, aromatic rings marked;
    missing hydrogens fill usual valences."""
    m = Molecule([*symbols], [0] * len(symbols), [0] * len(symbols), [False] * len(symbols), [(int(i), int(j), 1.5 if o == 4 else float(o)) for i, j, o in bonds], [0] * len(symbols), [""] * len(symbols))
    for i, near in enumerate(m.neighbours):
        used = int(sum(o for _, o in near) + 1e-9)
        room = [v for v in VALENCES.get(m.symbols[i], ()) if v >= used]
        m.hydrogens[i] = room[0] - used if room else 0
    m.rings = R.smallest_rings(m)
    R.aromatise(m, m.rings)
    return m


SHAPES: dict[str, Callable] = {"usr": shape, "usrcat": shape_by_class, "electroshape": charged_shape, "rdf": radial, "morse": scattering, "whim": principal, "autocorr3d": spatial_autocorrelation, "getaway": influence, "shells": shells}


#: Kinds that are made of all conformers of a molecule in a batch at once, for so many pairs of atoms at most.
TOGETHER: dict[str, Callable] = {"getaway": influences}
MOST_PAIRS = 1_000_000


def _together(make: Callable, atoms: pa.Array, bonds: pa.Array) -> pa.Array | None:
    """``make`` of a batch's conformers by molecule; None if a row needs to be judged on its own: nulls, few atoms, places that are no numbers."""
    a, t = atoms.flatten(), bonds.flatten()
    if atoms.null_count or bonds.null_count or any(c.null_count for c in (a, t, *a.flatten(), *t.flatten())) or not len(atoms):
        return None
    sizes, ties = (np.concatenate(([0], np.cumsum(pc.list_value_length(c).to_numpy()))) for c in (atoms, bonds))
    x = np.column_stack([a.field(k).to_numpy(zero_copy_only=False).astype(float) for k in "xyz"])
    if np.diff(sizes).min() < 3 or not np.isfinite(x).all():
        return None
    named = a.field("symbol").dictionary_encode()
    codes, names = named.indices.to_numpy(), named.dictionary.to_pylist()
    ends = np.column_stack([t.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("i", "j", "order")])
    alike: dict[tuple[bytes, bytes], list[int]] = {}
    for k in range(len(atoms)):
        alike.setdefault((codes[sizes[k] : sizes[k + 1]].tobytes(), ends[ties[k] : ties[k + 1]].tobytes()), []).append(k)
    order, values, lengths = [], [], []
    for rows in alike.values():
        k = rows[0]
        symbols, tied = [names[c] for c in codes[sizes[k] : sizes[k + 1]]], [(int(i), int(j), o) for i, j, o in ends[ties[k] : ties[k + 1]]]
        step = max(1, MOST_PAIRS // len(symbols) ** 2)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            made = make(symbols, x[sizes[some][:, None] + np.arange(len(symbols))], tied)
            order += some
            values.append(made.ravel())
            lengths += [made.shape[1]] * len(some)
    held = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(np.concatenate(values)))
    return held.take(pa.array(np.argsort(order)))


def shape_fingerprint(df: DataFrame, id_col: str, kind: str, atoms: str = "atoms", bonds: str = "bonds", out: str = "vector", errors: str = "raise") -> DataFrame:
    """(id, array<double>) of conformers as ``read_sdf`` gives them: ``atoms`` an array of x, y, z and
    symbol (and charge for "electroshape"), ``bonds`` one of i, j and order.

    A null row or one with fewer than three atoms raises, or gives null with errors "null".
    """
    if kind not in SHAPES or errors not in ("raise", "null"):
        raise ValueError("unknown kind or errors")
    make = SHAPES[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if kind in TOGETHER and (made := _together(TOGETHER[kind], b.column(1), b.column(2))) is not None:
                yield pa.RecordBatch.from_arrays([b.column(0), made], [id_col, out])
                continue
            rows: list[list[float] | None] = []
            for held, tied in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    if held is None:
                        raise ValueError("no atoms")
                    x = np.array([[a["x"], a["y"], a["z"]] for a in held], float).reshape(-1, 3)
                    more = {"charges": [a["charge"] for a in held]} if kind == "electroshape" and held and "charge" in held[0] else {}
                    rows.append(make([a["symbol"] for a in held], x, [(t["i"], t["j"], t["order"]) for t in tied or ()], **more))
                except ValueError:
                    if errors == "raise":
                        raise
                    rows.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], [id_col, out])

    return df.select(id_col, atoms, bonds).mapInArrow(run, T.StructType([df.schema[id_col], T.StructField(out, T.ArrayType(T.DoubleType()))]))
