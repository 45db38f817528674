import random

from retort.llm.graph import components
from retort.llm.staging import Staging


def roots_of(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100 + i, 100) for i in range(1, 30)]
    wild = [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    edges = [(a, b) for a, b in chain[::-1] + star + wild if a != b]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in components(df, Staging(spark), "c").collect()}
    assert got == roots_of(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long"), Staging(spark), "c").collect() == []
