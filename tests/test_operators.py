import numpy as np
import pytest
from pyspark.sql import functions as F

from retort.functions.moments import f_quantile, gram, t_two_sided
from retort.functions.shingles import hex_mod, lingo
from retort.operators import domain, metrics, rules, splits
from retort.sources import files


def test_lingo_of_short_and_null(spark):
    df = spark.createDataFrame([(1, "CCl"), (2, None), (3, "c1ccc1Br")], "id long, s string")
    assert {r["id"] for r in lingo(df, "id", "s").collect()} == {3}
    power = {(r["id"], r["bit"]): r["count"] for r in lingo(df, "id", "s", 1024).collect()}
    assert sum(power.values()) == len("c0ccc0R") - 3


def test_hex_mod(spark):
    text = "ffeeddccbbaa99887766554433221100ffeeddcc"
    assert spark.range(1).select(hex_mod(F.lit(text), 1000, 40)).first()[0] == int(text, 16) % 1000


def test_moments(spark):
    x = np.random.default_rng(1).normal(size=(50, 3))
    n, total, product = gram(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>"), "v")
    assert n == 50 and total == pytest.approx(x.sum(0)) and product == pytest.approx(x.T @ x)
    assert f_quantile(0.95, 3, 10) == pytest.approx(3.708, abs=1e-3)
    assert t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-3)


def test_domains_tell_inside_from_outside(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    rows = lambda a: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id long, v array<double>")
    train, near, far = rows(x), rows(x[:20] * 0.1), rows(x[:20] + 100)
    for make in (domain.bounding_box, domain.distance_to_centroid, domain.pca_box, domain.topkat):
        m = make(train, "v")
        assert all(r["inside"] for r in m.predict(near, "v").collect())
        assert not any(r["inside"] for r in m.predict(far, "v").collect())
    assert not any(r["inside"] for r in domain.leverage(train, "v").predict(far, "v").collect())
    assert not any(r["inside"] for r in domain.hotelling_t2(train, "v").predict(far, "v").collect())
    hull = domain.convex_hull(train, "v")
    assert all(r["inside"] for r in hull(near, "v").collect()) and not any(r["inside"] for r in hull(far, "v").collect())
    k = domain.knn_domain(train, "id", "v", domain.VECTOR_METRICS["euclidean"], k=3)
    assert not any(r["inside"] for r in k.predict(far, "id", "v").collect())


def test_screening_closed_forms(spark):
    df = spark.createDataFrame([(1 if i < 10 else 0, float(100 - i)) for i in range(100)], "y int, p double")
    got = metrics.screening_metrics(df, fraction=0.1).first()
    assert got["enrichment_factor"] == pytest.approx(10) and got["bedroc"] == pytest.approx(1.0)


def test_metrics_with_missing_and_constant_tasks(spark):
    rows = [("a", 1.0, 0.9), ("a", 0.0, 0.1), ("a", None, 0.5), ("b", 1.0, 0.2), ("b", 1.0, 0.3)]
    df = spark.createDataFrame(rows, "task string, y double, p double")
    got = {r["task"]: r["auroc"] for r in metrics.auroc(df).collect()}
    assert got == {"a": 1.0, "b": None}
    assert metrics.mean_over_tasks(metrics.auroc(df), "auroc").first()[0] == 1.0


def test_rules(spark):
    df = spark.createDataFrame([(1, 450.0, 3.0, 5.0, 4.0), (2, 600.0, 3.0, 5.0, 4.0), (3, 600.0, 30.0, 5.0, 4.0), (4, None, 3.0, 5.0, 4.0)], "id long, mol_weight double, lipinski_hba double, lipinski_hbd double, logp double")
    ids = lambda d: {r["id"] for r in d.collect()}
    assert ids(rules.apply_rules(df, "lipinski")) == {1, 2, 4}
    assert ids(rules.apply_rules(df, "lipinski", allow_one_violation=False)) == {1}
    with pytest.raises(ValueError):
        rules.apply_rules(df, "lipinski", return_type="other")


def test_splits(spark):
    df = spark.range(100).withColumn("g", (F.col("id") % 7).cast("string"))
    out = splits.group_fill_split(df, F.col("g"), "id", 10, 20).collect()
    assert len(out) == 100 and {r["subset"] for r in out} == {"train", "valid", "test"}
    of = {}
    for r in out:
        of.setdefault(r["g"], set()).add(r["subset"])
    assert all(len(s) == 1 for s in of.values())
    assert splits.subset_sizes(10, None, None, None) == (8, 1, 1)
    words = np.random.default_rng(0).integers(0, 2**63, (50, 1)).astype(np.uint64)
    assert len(set(splits.maxmin_pick(words, 10))) == 10
    lead = splits.leaders(words, 0.65)
    assert lead[0] == 0


def test_sdf_round_trip(spark, tmp_path):
    atoms = [(0.0, 1.5, -2.25, "C"), (1.0, 0.0, 0.0, "Cl")]
    df = spark.createDataFrame([("m1", atoms, [(0, 1, 1)]), ("m2", atoms[:1], [])], "title string, atoms array<struct<x: double, y: double, z: double, symbol: string>>, bonds array<struct<i: int, j: int, order: int>>")
    files.write_sdf(df, str(tmp_path / "out"))
    back = files.read_sdf(spark, str(tmp_path / "out")).drop("block", "properties")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_fasta_and_tables(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">p1 first\nACD\nEF\n>p2\nGG\n")
    assert {tuple(r) for r in files.read_fasta(spark, str(tmp_path / "a.fasta")).collect()} == {("p1", "ACDEF"), ("p2", "GG")}
    (tmp_path / "t.csv").write_text("SMILES,a,b\nCC,1,\nC,0,2\n")
    got = {(r["text"], r["task"], r["y"]) for r in files.read_table(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {("CC", "a", 1.0), ("CC", "b", None), ("C", "a", 0.0), ("C", "b", 2.0)}
    (tmp_path / "s.json").write_text('{"train": [0, 1], "test": [2]}')
    assert {tuple(r) for r in files.read_splits(spark, str(tmp_path / "s.json")).collect()} == {("train", 0), ("train", 1), ("test", 2)}


def test_matrix_domains_use_the_whole_vector(spark, tmp_path):
    from retort.functions.moments import f_quantile
    from retort.plans import catalog

    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    label = np.arange(400) % 10
    x[label >= 5, 8:] *= rng.choice([0.3, 1, 1.5], size=(200, 1))  # what tells is behind the first eight numbers
    spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(400)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = x.astype(float)
    train, test, ids = x[label < 5], x[label >= 5], np.flatnonzero(label >= 5).tolist()
    n, d = train.shape
    form = lambda rows, m: np.einsum("ij,jk,ik->i", rows, np.linalg.pinv(m), rows)
    mean, cov = train.mean(0), np.cov(train.T)
    low, width = train.min(0), np.ptp(train, 0)
    scaled = lambda rows: np.column_stack([2 * (rows - low) / width - 1, np.ones(len(rows))])
    axes = np.linalg.eigh(cov)[1]
    inner, outer = (train - mean) @ axes, (test - mean) @ axes
    want = {
        "ad_leverage": form(test, train.T @ train) <= 3 * (d + 1) / n,
        "ad_hotelling_t2": form(test - mean, cov) <= d * (n - 1) * (n + 1) / (n * (n - d)) * f_quantile(0.1, d, n - d),
        "ad_pca_box": ((outer >= inner.min(0) - 1e-9) & (outer <= inner.max(0) + 1e-9)).all(1),
        "ad_topkat": form(scaled(test), scaled(train).T @ scaled(train)) < 5 * d / (2 * n),
    }
    for name, verdict in want.items():
        if name == "ad_hotelling_t2":
            fit_on, judged = catalog._train_test(spark, str(tmp_path))
            out = catalog.domain.hotelling_t2(fit_on, "x").predict(judged, "x")
        else:
            out = catalog.queries()[name](spark, str(tmp_path))
        got = {r["vec_id"]: r["inside"] for r in out.collect()}
        assert got == dict(zip(ids, verdict.tolist(), strict=True)), name
    assert len({v.tobytes() for v in want.values()}) > 1 and any(0 < v.sum() < len(v) for v in want.values())


def test_threshold_links_of_all_vectors(spark, tmp_path):
    from retort.plans import catalog

    rng = np.random.default_rng(13)
    x = rng.normal(size=(120, 64)).astype(np.float32)
    x[60:90], x[90:93] = x[:30], -1  # classes of two, and one of three empty vectors
    spark.createDataFrame([(i + 1, x[i].tolist(), 0) for i in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    bits = (x > 0).astype(int)
    both = bits @ bits.T
    union = bits.sum(1)[:, None] + bits.sum(1) - both
    links = (np.where(union == 0, 1, both / np.maximum(union, 1)) >= 0.4).sum(1) - 1
    want = {(i + 1, min(j + 1 for j in range(120) if (bits[j] == bits[i]).all()), int(links[i])) for i in range(120)}
    assert {tuple(r) for r in catalog.queries()["tanimoto_threshold_join"](spark, str(tmp_path)).collect()} == want


def test_links_of_packed_vectors_in_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from retort.functions import similarity
    from retort.operators import packed

    monkeypatch.setattr(packed, "LEAST", 30)
    monkeypatch.setattr(packed, "WIDE", 7)
    rng = np.random.default_rng(21)
    for width in (64, 130):
        bits = rng.random((100, width)) < 0.3
        bits[40:60], bits[60:63] = bits[:20], False
        weight = rng.integers(1, 4, 100)
        df = spark.createDataFrame([(i, bits[i].tolist(), int(weight[i])) for i in range(100)] + [(200, None, 5)], "id long, on array<boolean>, w long")
        df = df.select("id", similarity.pack_bits(F.col("on"), width).alias("bits"), "w")
        both = bits.astype(int) @ bits.T.astype(int)
        union = bits.sum(1)[:, None] + bits.sum(1) - both
        near = np.where(union == 0, 1, both / np.maximum(union, 1))
        got = {r["i"]: r["links"] for r in packed.tanimoto_links(df, df, "id", "bits", "bits", "w", 0.25, width).collect()}
        assert got == {i: int(n) for i, n in enumerate(((near >= 0.25) * weight).sum(1))}


def test_nearest_packed_vectors_are_those_of_the_plain_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    from retort.functions import similarity
    from retort.operators import domain, packed, pairs

    monkeypatch.setattr(packed, "LEAST", 30)
    monkeypatch.setattr(packed, "WIDE", 7)
    rng = np.random.default_rng(22)
    for width in (64, 130):
        bits = rng.random((90, width)) < 0.3
        bits[40:60], bits[60:63], bits[63:70] = bits[:20], False, bits[5]
        df = spark.createDataFrame([(i, bits[i].tolist()) for i in range(90)] + [(200, None)], "id long, on array<boolean>").select("id", similarity.pack_bits(F.col("on"), width).alias("bits"))
        metric = lambda x, y: F.round(similarity.binary_distance("tanimoto", x, y, width), 9)  # noqa: B023, E731
        fast = lambda *a: packed.tanimoto_knn(*a, width).withColumn("distance", F.round("distance", 9))  # noqa: B023, E731
        held = df.filter("id < 100")
        want = {tuple(r) for r in pairs.knn_join(held.filter("id % 3 = 0"), held, "id", "id", "bits", "bits", metric, 4).collect()}
        assert {tuple(r) for r in fast(df.filter("id % 3 = 0"), df, "id", "id", "bits", "bits", 4).collect()} == want
    one, two = (domain.knn_domain(held, "id", "bits", metric, k=2, nearest=n) for n in (None, fast))
    assert one.limit == two.limit


def test_neighbour_domain_judges_every_test_vector(spark, tmp_path):
    from retort.plans import catalog

    rng = np.random.default_rng(23)
    x = rng.normal(size=(150, 64)).astype(np.float32)
    x[60:70], x[70:73] = x[:10], -1  # some rows have equal bits, three have none
    label = np.arange(150) % 10
    rows = [(i + 1, x[i].tolist(), int(label[i])) for i in range(150)] + [(151, None, 3), (152, None, 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    bits = (x > 0).astype(int)
    both = bits @ bits.T
    union = bits.sum(1)[:, None] + bits.sum(1) - both
    near = np.sort((1 - np.where(union == 0, 1, both / np.maximum(union, 1)))[:, label < 5], 1)
    limit = np.percentile(near[label < 5, 1:3].mean(1), 95)
    score = near[:, :3].mean(1)
    want = {i + 1: (round(score[i], 6), bool(score[i] <= limit)) for i in range(150) if label[i] >= 5} | {152: (None, None)}
    got = catalog.queries()["ad_knn"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 76 and {r["vec_id"]: (r["score"], r["inside"]) for r in got} == {k: (v and pytest.approx(v), w) for k, (v, w) in want.items()}
    assert {w for _, w in want.values()} == {True, False, None}


def test_neighbour_domain_rounds_halves_as_its_sql(spark, tmp_path):
    import duckdb

    from retort.plans import catalog

    x = -np.ones((4, 64), np.float32)
    for i, (shared, more) in enumerate([(32, 0), (25, 15), (23, 12), (25, 16)]):  # distances 22/47, 21/44 and 23/48, whose mean is 0.4748415
        x[i, :shared], x[i, 32 : 32 + more] = 1, 1
    rows = [(i + 1, x[i].tolist(), 0 if i else 9) for i in range(4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["ad_knn"]).fetchall()
    assert want[0][:2] == (1, 0.474842)
    assert [tuple(r) for r in catalog.queries()["ad_knn"](spark, str(tmp_path)).collect()] == want


def test_running_sums_and_percentiles_by_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    from retort.operators import running

    rng = np.random.default_rng(4)
    rows = [(int(k), float(v), int(n)) for k, v, n in zip(rng.integers(0, 3, 3000), rng.permutation(3000) / 7, rng.integers(0, 9, 3000), strict=True)]
    df = spark.createDataFrame(rows, "k int, v double, n long")
    plain = running.running_sums(df, ["k"], "v", {"s": F.col("n")}, descending=True).collect()
    monkeypatch.setattr(running, "ONE_WINDOW", 10)
    dealt = running.running_sums(df, ["k"], "v", {"s": F.col("n")}, descending=True).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, dealt))
    alone = running.running_sums(df, [], "v", {"s": F.col("n")}).collect()
    order = sorted(rows, key=lambda r: r[1])
    assert [r["s"] for r in sorted(alone, key=lambda r: r["v"])] == np.concatenate(([0], np.cumsum([r[2] for r in order])[:-1])).tolist()
    got = {r["k"]: (r["p0"], r["p1"], r["p2"]) for r in running.exact_percentiles(df, "k", "v", [0.0, 0.37, 0.99]).collect()}
    for k in range(3):
        values = [r[1] for r in rows if r[0] == k]
        assert got[k] == pytest.approx(np.percentile(values, [0, 37, 99]))


def test_sdf_data_items(spark, tmp_path):
    block = "name\n  x\n\n  1  0  0  0  0  0  0  0  0  0999 V2000\n    1.0000    2.0000    3.0000 C   0  0\nM  END\n> <LogP>\n1.5\n\n>  <NAME> (1)\nab c\n\n$$$$\n"
    (tmp_path / "a.sdf").write_text(block * 2)
    got = files.read_sdf(spark, str(tmp_path / "a.sdf")).collect()
    assert len(got) == 2 and all([tuple(p) for p in r["properties"]] == [("LogP", "1.5"), ("NAME", "ab c")] for r in got)
    assert got[0]["title"] == "name" and got[0]["atoms"][0]["z"] == 3.0
