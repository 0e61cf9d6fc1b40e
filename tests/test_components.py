"""Connected components against union-find, with hubs that the joins split."""

import random

import pytest

from duonet.operators import components as c


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("hot", [2, 64])
def test_hubs_chains_and_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(c, "LEAST_HOT", hot)
    rng = random.Random(4)
    edges = [(5, 1000 + k) for k in range(300)] + [(2000 + k, 2001 + k) for k in range(40)] + [(1010, 2020), (7, 7), (8, 9), (9, 8)]
    edges += [(rng.randint(3000, 3200), rng.randint(3000, 3200)) for _ in range(90)]
    rng.shuffle(edges)
    out = c.components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["root"] for r in out}
    assert len(out) == len(got)
    assert got == {x: r for x, r in brute([e for e in edges if e[0] != e[1]]).items()}


def test_no_edges(spark):
    assert c.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_too_few_rounds_raise(spark, monkeypatch):
    monkeypatch.setattr(c, "MAX_ROUNDS", 1)
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")
    with pytest.raises(RuntimeError):
        c.components(chain)
