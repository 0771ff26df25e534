import random

import numpy as np

from quire.llm import components as cc


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def shapes():
    rng = random.Random(3)
    yield []
    yield [(1, 1), (2, 2)]
    yield [(k, k + 1) for k in range(300)]
    yield [(7, k) for k in range(-40, 400)]
    yield [(rng.randrange(400), rng.randrange(400)) for _ in range(220)]
    chain = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(200)]
    yield [*zip(chain, chain[1:], strict=False), (5, 6), (6, 5), (6, 6)]


def test_components_of_chains_stars_and_random_edges(spark, monkeypatch):
    monkeypatch.setattr(cc, "SLICE", 50)
    for edges in shapes():
        df = spark.createDataFrame(edges, "a long, b long").repartition(5)
        got = {r.node: r.component for r in cc.components(df).collect()}
        assert got == brute([e for e in edges if e[0] != e[1]])


def test_contraction():
    for edges in shapes():
        a, b = (np.array([e[k] for e in edges], dtype=np.int64) for k in range(2))
        assert dict(zip(*(x.tolist() for x in cc.contract(a, b)), strict=True)) == {x: r for x, r in brute(edges).items() if x != r}
