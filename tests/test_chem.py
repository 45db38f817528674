import hashlib
import math

import numpy as np
import pytest

from retort.chem import descriptors as D
from retort.chem import fingerprints as P
from retort.chem import common, fragments, properties, shapes, smarts, substructure, vectors, writer
from retort.chem.rings import molecule
from retort.chem.smiles import SmilesError, largest_fragment, parse


@pytest.mark.parametrize("text", ["", "C(", "C1CC", "C)", "Xx", "1C", "C11"])
def test_bad_smiles(text):
    with pytest.raises(SmilesError):
        parse(text)


def test_known_values():
    m = parse("CC(=O)Oc1ccccc1C(=O)O")
    assert D.molecular_weight(m) == pytest.approx(180.16, abs=0.01)
    assert (D.number_of_rings(m), D.heavy_atom_count(m), D.wiener_index(m)) == (1, 13, 246)
    hexane = parse("CCCCCC")
    assert D.wiener_index(hexane) == 35 and D.diameter(hexane) == 5 and D.radius(hexane) == 3
    assert D.petitjean_index(hexane) == pytest.approx(2 / 3)
    assert D.polarity_number(hexane) == 3 and D.zagreb_index_m2(hexane) == 4 * 3 + 2 * 2
    assert D.balaban_j_index(parse("CC")) == pytest.approx(1.0)


def test_distances_against_floyd():
    m = parse("CN1C=NC2=C1C(=O)N(C(=O)N2C)C")
    d = np.full((len(m.symbols),) * 2, 99.0)
    np.fill_diagonal(d, 0)
    for i, j, _ in m.bonds:
        d[i, j] = d[j, i] = 1
    for k in range(len(d)):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    assert (D.distances(m) == d).all()


def test_fingerprints_ignore_atom_order():
    for kind in P.KINDS.values():
        assert kind(parse("OCC")) == kind(parse("CCO"))
    assert P.scaffold_key(molecule("CCc1ccccc1")) == P.scaffold_key(molecule("C1=CC=CC=C1O"))
    assert P.scaffold_key(molecule("CCO")) == ""
    assert largest_fragment("[Na+].CCO") == "CCO"


def test_shapes_do_not_depend_on_place():
    x = np.random.default_rng(0).normal(size=(9, 3))
    line = [(i, i + 1, 1) for i in range(8)]
    assert shapes.shape(['C'] * 9, x, line) == pytest.approx(shapes.shape(['C'] * 9, x + 5, line))
    for kind, n in (("usr", 12), ("usrcat", 60), ("electroshape", 15), ("rdf", 210), ("morse", 224), ("whim", 78)):
        got = shapes.SHAPES[kind](['C'] * 9, x, line)
        assert len(got) == n and not any(math.isnan(v) for v in got)


def test_describe_gives_nulls(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "not smiles"), (3, None)], "id long, s string")
    got = {r["id"]: r["wiener_index"] for r in P.describe(df, "id", "s", ("wiener_index",)).collect()}
    assert got == {1: 4.0, 2: None, 3: None}


@pytest.mark.parametrize("text, rings, aromatic", [("C1=CC=CC=C1", [6], 6), ("CN1C=NC2=C1C(=O)N(C(=O)N2C)C", [5, 6], 9), ("C1=CC=C2C=CC=CC2=C1", [6, 6], 10), ("C1=CNC=C1", [5], 5), ("O=C1C=CC(=O)C=C1", [6], 0), ("c1cc2ccc3cccc4ccc(c1)c2c34", [6, 6, 6, 6], 16), ("C12C3C4C1C5C2C3C45", [4] * 5, 0)])
def test_rings_and_aromaticity(text, rings, aromatic):
    m = molecule(text)
    assert sorted(map(len, m.rings)) == rings and sum(m.aromatic) == aromatic


@pytest.mark.parametrize("smiles, logp, tpsa, flexible", [("CC(=O)Nc1ccc(O)cc1", 1.3506, 49.33, 1), ("CN1C=NC2=C1C(=O)N(C(=O)N2C)C", -1.0293, 61.82, 0), ("CC(=O)Oc1ccccc1C(=O)O", 1.3101, 63.6, 2), ("CC(C)CC1=CC=C(C=C1)C(C)C(=O)O", 3.0732, 37.3, 4), ("c1ncccc1[C@@H]2CCCN2C", 1.8483, 16.13, 1)])
def test_known_properties(smiles, logp, tpsa, flexible):
    m = molecule(smiles)
    assert (round(properties.logp(m), 4), round(properties.tpsa(m), 2), properties.rotatable_bonds(m)) == (logp, tpsa, flexible)


@pytest.mark.parametrize("smiles, j, k1, k2, k3", [("CC", 1, 2, 0, 0), ("CCO", 1.633, 2.96, 1.96, 1.96), ("O=C=O", 3.266, 2.38, 1.38, 1.38), ("c1ccccc1", 3, 3.412, 1.606, 0.582), ("CC(=O)O", 2.803, 3.47, 0.875, 1.156), ("CC(C)C", 2.324, 4, 1.333, 0), ("c1ccncc1", 3, 3.344, 1.553, 0.549)])
def test_shape_indices(smiles, j, k1, k2, k3):
    m = molecule(smiles)
    got = [D.balaban_j_index(m), properties.kappa1_index(m), properties.kappa2_index(m), properties.kappa3_index(m)]
    assert got == pytest.approx([j, k1, k2, k3], abs=1e-3)


@pytest.mark.parametrize("text, smiles, n", [("[#6]", "c1ccccc1", 6), ("C(=O)O", "CC(=O)Oc1ccccc1C(=O)O", 2), ("[R2]", "c1ccc2ccccc2c1", 2), ("[r5]", "c1ccc2[nH]ccc2c1", 5), ("C=,#N", "CC#N", 1), ("[#6]!@[#6]", "CC1CC1", 1), ("[NX3;H2,H1;!$(NC=O)]", "CC(=O)NCCN", 1), ("C.O", "CO", 1), ("[x3]", "c1ccc2ccccc2c1", 2), ("[H]", "[H][H]", 2), ("[CH2X4]a", "CCc1ccccc1", 1), ("c1ccccc1", "c1ccc2ccccc2c1", 2)])
def test_patterns(text, smiles, n):
    assert smarts.pattern(text).count(smarts.View(molecule(smiles))) == n


@pytest.mark.parametrize("text", ["", "[", "C(", "C)", "C1", "[Qq]", "[$(C]", "C?C"])
def test_bad_patterns(text):
    with pytest.raises((smarts.SmartsError, KeyError)):
        smarts.pattern(text)


def test_pattern_filter_of_molecules(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "CC(=O)O"), (3, "C(=O)(O)CC(=O)O"), (4, "no molecule"), (5, None)], "id long, s string")
    unwanted = [("acid", "C(=O)[OH]", 1, True), ("two", "[OH]", 2, True), ("flag", "[OH]", 1, False)]
    run = lambda **o: {r["id"]: r["passed"] for r in substructure.filter_by_patterns(df, "id", "s", unwanted, return_type="indicators", errors="ignore", **o).collect()}
    assert run() == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert run(allow_one_violation=True) == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert run(severity=1)[1] is False
    with pytest.raises(Exception, match="unexpected"):
        substructure.filter_by_patterns(df, "id", "s", unwanted).collect()


def test_burden_matrix_of_wrong_input():
    with pytest.raises(ValueError):
        D.burden_matrix(molecule("O"), [1.0, 2.0, 3.0])
    with pytest.raises(ValueError):
        D.burden_matrix(molecule("[Rh-](Cl)(Cl)(Cl)(Cl)$[Rh-](Cl)(Cl)(Cl)Cl"))


@pytest.mark.parametrize("one, two", [("CC(=O)Oc1ccccc1C(=O)O", "OC(=O)C1=CC=CC=C1OC(C)=O"), ("CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "Cn1cnc2c1c(=O)n(C)c(=O)n2C"), ("C1CC2CCC1CC2", "C12CCC(CC1)CC2"), ("[NH4+].[Cl-]", "[Cl-].[NH4+]"), ("c1ccc2[nH]ccc2c1", "[nH]1ccc2ccccc12"), ("C1CC1c1ccccc1-c1ccccc1", "c1ccc(cc1)-c1ccccc1C1CC1"), ("[13CH3]C#N", "N#C[13CH3]")])
def test_one_text_for_one_molecule(one, two):
    text = writer.to_smiles(molecule(one))
    assert text == writer.to_smiles(molecule(two)) == writer.to_smiles(molecule(text))
    assert writer.circular_shingles(molecule(one)) == writer.circular_shingles(molecule(two))
    assert writer.pair_shingles(molecule(one), duplicates=True) == writer.pair_shingles(molecule(two), duplicates=True)


def test_charges_sum_to_the_charge():
    q = vectors.partial_charges(molecule("CCO"), "gasteiger")
    assert q[2] < q[0] < q[1] and -0.5 < q[2] < -0.3
    with pytest.raises(ValueError):
        vectors.partial_charges(molecule("[Fe]"), "gasteiger")
    assert len(vectors.autocorrelation(molecule("c1ccccc1O"))) == 192 and len(vectors.burden_eigenvalues(molecule("CCO"))) == 8


def test_minhash_of_shingles(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "OCC"), (3, "c1ccccc1"), (4, "CCCO")], "id long, s string")
    got = {}
    for r in writer.minhash_circular(df, "id", "s", size=64).collect():
        got.setdefault(r["id"], {})[r["slot"]] = r["value"]
    assert got[1] == got[2] and got[1] != got[4] and len(got[3]) == 64
    bits = {i: {r["bit"] for r in writer.folded_circular(df, "id", "s").collect() if r["id"] == i} for i in (1, 2, 3)}
    assert bits[1] == bits[2] and not bits[1] & bits[3]


def test_minhash_against_plain_hashes_without_a_shuffle_of_slots(spark):
    df = spark.createDataFrame([(1, "CCO"), (1, "c1ccccc1"), (1, "CCO"), (2, "C1CCCCC1CC"), (3, "no molecule"), (4, None), (None, "CCN")], "id long, s string")
    want = {}
    for i, text in [(1, "CCO"), (1, "c1ccccc1"), (2, "C1CCCCC1CC"), (None, "CCN")]:
        for x in writer.circular_shingles(molecule(text)):
            h = int.from_bytes(hashlib.sha1(x.encode()).digest()[:4], "little") % writer.PRIME
            for k in range(16):
                v = (writer._seed("a", k) * h + writer._seed("b", k)) % writer.PRIME
                want[i, k] = min(want.get((i, k), v), v)
    out = writer.minhash_circular(df, "id", "s", size=16, errors="null")
    assert out.dtypes == [("id", "bigint"), ("slot", "int"), ("value", "bigint")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((i, k, v) for (i, k), v in want.items()), key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Aggregate") == 1  # texts are grouped, slots are not
    with pytest.raises(Exception, match="(?i)smiles"):
        writer.minhash_circular(df, "id", "s").collect()


def test_influence_of_many_conformers_at_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    molecules = [(["C", "N", "C", "O", "C"], [(k, k + 1, 1) for k in range(4)]), (["C", "H", "O", "H"], [(0, 1, 1), (0, 2, 1), (2, 3, 1)]), (["C"] * 6, [(k, (k + 1) % 6, 4) for k in range(6)]), (["C"] * 3, [])]
    rows = []
    for k in range(40):
        symbols, bonds = molecules[k % 4]
        x = np.round(rng.normal(size=(len(symbols), 3)) * 4) / 4 * ((1, 1, 1), (1, 1, 0), (1, 0, 0), (0, 0, 0))[k // 4 % 4]
        rows.append((k, [(*map(float, p), s) for p, s in zip(x, symbols, strict=True)], bonds))
    want = {k: shapes.influence([a[3] for a in held], np.array([a[:3] for a in held]), bonds) for k, held, bonds in rows}
    kind = "id long, atoms array<struct<x: double, y: double, z: double, symbol: string>>, bonds array<struct<i: int, j: int, order: int>>"
    alone = []
    make = shapes.SHAPES["getaway"]
    monkeypatch.setitem(shapes.SHAPES, "getaway", lambda *a: alone.append(1) or make(*a))
    monkeypatch.setattr(shapes, "MOST_PAIRS", 60)
    batch = spark.createDataFrame(rows, kind).toArrow().combine_chunks()
    made = shapes._together(shapes.influences, batch["atoms"].chunk(0), batch["bonds"].chunk(0)).to_pylist()
    assert not alone and all(np.allclose(made[k], want[k], rtol=0, atol=1e-9) for k in range(40))
    got = {r["id"]: r["vector"] for r in shapes.shape_fingerprint(spark.createDataFrame([*rows, (40, None, None)], kind), "id", "getaway", errors="null").collect()}
    assert got.pop(40) is None and all(np.allclose(got[k], want[k], rtol=0, atol=1e-9) for k in range(40))


@pytest.mark.parametrize("measure", [common.pair_similarity, fragments.pair_fragment_similarity])
def test_each_pair_of_texts_is_measured_once(spark, tmp_path, measure):
    from retort.plans import molecules

    spark.range(5, 806, 5).withColumnRenamed("id", "p_partkey").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    asked = []
    out = molecules._against_all(lambda df, one, two: asked.append(df) or measure(df, one, two))(spark, str(tmp_path))
    pairs = [(r["one"], r["smiles"]) for r in asked[0].collect()]
    assert len(pairs) == len(set(pairs))
    got = out.collect()
    keys = range(5, 806, 5)
    assert sorted((r["i"], r["j"]) for r in got) == [(i, j) for i in keys if i % 100 == 0 for j in keys]
    assert all(0 <= r["similarity"] <= 1 and abs(r["similarity"] + r["distance"] - 1) < 1e-5 for r in got)


def test_fragments_by_classes_hold_all_pairs_of_rows(spark, tmp_path):
    from retort.plans import molecules

    spark.range(2, 1007, 3).withColumnRenamed("id", "p_partkey").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    want = {(r["i"], r["j"]): (r["similarity"], r["distance"]) for r in molecules._against_all(fragments.pair_fragment_similarity)(spark, str(tmp_path)).collect()}
    out = molecules.QUERIES["bulk_fragments"](spark, str(tmp_path)).collect()
    keys = range(2, 1007, 3)
    class_of = {r["j"]: r["i"] for r in out if r["kind"] == "member"}
    assert sorted(r["j"] for r in out if r["kind"] == "member") == list(keys)
    classes, asked = set(class_of.values()), {class_of[i] for i in keys if i % 100 == 0}
    met = {(r["i"], r["j"]): (r["similarity"], r["distance"]) for r in out if r["kind"] == "pair"}
    assert set(met) == {(i, j) for i in asked for j in classes} and len(out) == len(met) + len(class_of)
    assert {(i, j): met[class_of[i], class_of[j]] for i in keys if i % 100 == 0 for j in keys} == want
    assert len(met) < len(want) and all(k == class_of[k] == min(j for j, c in class_of.items() if c == k) for k in classes)


def test_shape_operator(spark):
    atoms = "array<struct<x: double, y: double, z: double, symbol: string>>"
    df = spark.createDataFrame([(1, [(0.0, 0.0, 0.0, "C"), (1.0, 0.0, 0.0, "C"), (0.0, 1.0, 0.0, "O")], [(0, 1, 1), (0, 2, 1)]), (2, None, None), (3, [(0.0, 0.0, 0.0, "C")], [])], f"id long, atoms {atoms}, bonds array<struct<i: int, j: int, order: int>>")
    got = {r["id"]: r["vector"] for r in shapes.shape_fingerprint(df, "id", "usr", errors="null").collect()}
    assert len(got[1]) == 12 and got[2] is None and got[3] is None


def test_surface_of_benzene():
    bins = vectors.surface_bins(molecule("c1ccccc1"), ("logp", "refractivity"))
    assert len(vectors.surface_bins(molecule("CCO"))) == 47 and bins[5] == pytest.approx(36.398, abs=1e-3) and sum(bins) == pytest.approx(2 * bins[5])


def test_parts_of_a_molecule_pass_the_screen():
    from retort.chem import pharmacophores

    whole, part = pharmacophores.screening_paths(molecule("CC(=O)Oc1ccccc1C(=O)O")), pharmacophores.screening_paths(molecule("CC(=O)O"))
    assert set(part) <= set(whole) and not set(whole) <= set(part)


def test_common_substructure_and_fragments():
    from retort.chem import fragments

    one, two = molecule("COc1cc(CN2CCC(NC(=O)c3cncc(C)c3)CC2)c(OC)c2ccccc12"), molecule("COc1ccccc1")
    assert 1 - common.similarity(one, two) == pytest.approx(0.7419354838709677)
    assert common.similarity(two, two) == fragments.fragment_similarity(two, two) == 1.0
    plain = fragments._tanimoto({f for f, _ in fragments.path_features(one)}, {f for f, _ in fragments.path_features(two)})
    assert plain <= fragments.fragment_similarity(one, two) < 1


def test_required_molecules(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "c1ccccc1")], "id long, s string")
    assert substructure.require_molecules(df, "s").collect() == df.collect()
    with pytest.raises(Exception, match="no molecule: C\\("):
        substructure.require_molecules(df.union(spark.createDataFrame([(3, "C(")], df.schema)), "s").collect()
