import math

import pytest
from pyspark.sql import functions as F

from retort.functions import similarity as S
from retort.operators import pairs

VECTORS = [[1, 0, 0, 1], [1, 0, 1, 0], [0, 0, 0, 0], [1, 1, 1, 1], [0, 1, 1, 0], [1, 0, 0, 1]]


def frame(spark):
    df = spark.createDataFrame(list(enumerate(VECTORS)), "i long, v array<int>")
    return df.select("i", S.pack_bits(F.transform("v", lambda x: x > 0), 4).alias("bits"), F.transform("v", lambda x: x.cast("double")).alias("c"))


def expected(name, x, y):
    a = sum(p and q for p, q in zip(x, y))
    b, c = sum(x) - a, sum(y) - a
    d = len(x) - a - b - c
    n = len(x)
    if name == "tanimoto":
        return a / (a + b + c) if a + b + c else 1
    if name == "dice":
        return 2 * a / (sum(x) + sum(y)) if sum(x) + sum(y) else 1
    if name == "ct4":
        return math.log(1 + a) / math.log(1 + a + b + c) if a + b + c else 1
    if name == "braun_blanquet":
        return a / max(sum(x), sum(y)) if max(sum(x), sum(y)) else 1
    if name == "simpson":
        return a / min(sum(x), sum(y)) if min(sum(x), sum(y)) else 0
    if name == "kulczynski":
        return 1 if not sum(x) + sum(y) else 0 if not sum(x) * sum(y) else (a / sum(x) + a / sum(y)) / 2
    if name == "mcconnaughey":
        return 1 if not sum(x) + sum(y) else -1 if not sum(x) * sum(y) else a / sum(x) + a / sum(y) - 1
    if name == "sokal_sneath_2":
        return a / (a + 2 * b + 2 * c) if a + b + c else 1
    if name == "rand":
        return (a + d) / n
    if name == "russell":
        return a / n
    if name == "rogot_goldberg":
        return 1 if 2 * a + b + c == 0 or 2 * d + b + c == 0 else a / (2 * a + b + c) + d / (2 * d + b + c)
    return 1 if a + b + c == 0 or b + c + d == 0 else a * (2 * d + b + c) / (2 * (a + b + c)) + d * (2 * a + b + c) / (2 * (b + c + d))


@pytest.mark.parametrize("name", list(S.BINARY))
def test_binary_families(spark, name):
    df = frame(spark)
    got = pairs.pair_join(df, df, "i", "i", "bits", "bits", lambda x, y: S.binary_similarity(name, x, y, 4)).collect()
    assert len(got) == len(VECTORS) ** 2
    for r in got:
        assert r["value"] == pytest.approx(expected(name, VECTORS[r["i"]], VECTORS[r["j"]]), abs=1e-9)


def test_counts_agree_with_bits_on_bits(spark):
    df = frame(spark)
    for name in ("tanimoto", "dice"):
        bits = {(r["i"], r["j"]): r["value"] for r in pairs.pair_join(df, df, "i", "i", "bits", "bits", lambda x, y: S.binary_similarity(name, x, y, 4)).collect()}
        counts = {(r["i"], r["j"]): r["value"] for r in pairs.pair_join(df, df, "i", "i", "c", "c", lambda x, y: S.count_similarity(name, x, y)).collect()}
        assert bits == pytest.approx(counts)


def test_threshold_join_and_blocks(spark, monkeypatch):
    df = frame(spark)
    want = {(i, j) for i in range(6) for j in range(6) if expected("tanimoto", VECTORS[i], VECTORS[j]) >= 0.5}
    assert {(r["i"], r["j"]) for r in pairs.tanimoto_join(df, df, "i", "i", "bits", "bits", 0.5).collect()} == want
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 2)
    assert pairs.pair_join(df, df, "i", "i", "bits", "bits", lambda x, y: S.binary_similarity("rand", x, y, 4)).count() == 36


def test_on_bits(spark):
    df = frame(spark).select("i", S.on_bits(F.col("bits")).alias("on"))
    assert {r["i"]: r["on"] for r in df.collect()} == {i: [k for k, v in enumerate(x) if v] for i, x in enumerate(VECTORS)}
