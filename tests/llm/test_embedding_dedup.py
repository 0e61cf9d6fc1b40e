import numpy as np

from duonet.llm import embedding_dedup as e


def brute(found, threshold):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        return a / np.linalg.norm(a)

    u = [unit(v) for _, v in found]
    n = len(u)
    parent, links = list(range(n)), [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if u[a] is not None and u[b] is not None and len(u[a]) == len(u[b]) and u[a] @ u[b] >= threshold:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(found):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, links[k], least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(found))


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(2)
    found = []
    for c in range(30):
        base = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 9))):
            found.append((len(found), (base + rng.normal(size=8) * 0.12).tolist()))
    hot = rng.normal(size=8).tolist()
    found += [(len(found) + k, hot) for k in range(60)]
    found += [(len(found) + k, (np.array(hot) + rng.normal(size=8) * 0.05).tolist()) for k in range(60)]
    n = len(found)
    found += [(n, None), (n + 1, [0.0] * 8), (n + 2, [1.0] * 3), (n + 3, [None] * 8), (n + 4, [float("nan")] * 8), (n + 5, [float("inf")] * 8), (n + 6, [3.0 * x for x in hot])]
    found += [(n + 10 + k, [1.0, 2.0, 3.0 + k / 50]) for k in range(6)] + [(n + 20, []), (n + 21, [1.0, 2.0]), (n + 22, [2.0, 4.0])]  # other lengths link among themselves
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in found], "vec_id long, embedding array<double>, node string, key int").repartition(3)
    old, e.BLOCK = e.BLOCK, 16  # several runs a bucket
    try:
        out = e.near_duplicates(df).collect()
    finally:
        e.BLOCK = old
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out)
    want = brute(found, 0.95)
    total = sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.98 * total
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.9 * len(want)


def test_expected_recall_of_the_plan():
    for n in (10, 10_000, 10**9):
        k, tables = e.plan(n, 0.95)
        assert 1 - (1 - e.meet(np.sqrt(0.1), e.WIDTH) ** k) ** tables >= e.RECALL - 1e-9


def test_empty_and_repeated(spark):
    kind = "vec_id long, embedding array<float>"
    assert e.near_duplicates(spark.createDataFrame([], kind)).collect() == []
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)], kind)
    assert sorted(tuple(r) for r in e.near_duplicates(twice).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_lengths_are_compared_apart(spark):
    """Ties of lengths, and short vectors beside long ones: each is compared with its own length."""
    kind = "vec_id long, embedding array<double>"
    found = [(1, [1.0, 2.0]), (2, [1.0, 2.001]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 3.001]), (5, [1.0, 2.0, 0.0])]
    out = e.near_duplicates(spark.createDataFrame(found, kind)).collect()
    assert sorted(tuple(r) for r in out) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)]
