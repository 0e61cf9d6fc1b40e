import pytest

from duonet.llm import ngram_join as j
from duonet.llm._common import join_salted
from tests.llm.corpus import empty, frame, rows


def sets_of(found, n):
    out = []
    for r in found:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (r[1] or "")).encode().split()
        m = min(n, len(w))
        out.append({tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if w else set())
    return out


def brute(found, n, percent):
    s = sets_of(found, n)
    parent = list(range(len(s)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, r in enumerate(found):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return sorted((r[0] or -1, len(s[k]), least.get(root(k), -1) if s[k] else (r[0] or -1)) for k, r in enumerate(found))


@pytest.mark.parametrize(("n", "percent", "rounds"), [(3, 90, 2), (5, 80, 2), (5, 80, 0)])
def test_components_match_brute_force(spark, n, percent, rounds):
    out = j.ngram_components(frame(spark), n=n, percent=percent, star_rounds=rounds).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in out) == brute(rows(), n, percent)


def test_planted_pairs_at_the_threshold_are_found(spark):
    """Pairs whose similarity is just at or above the limit, at many sizes."""
    import random

    rng = random.Random(5)
    found, i = [], 0
    for size in (5, 9, 11, 19, 20, 21, 40, 100, 333, 1000):
        words = [f"w{size}x{k}" for k in range(size + 2)]
        for cut in range(0, size // 8 + 2):
            found.append((i, " ".join(words[: len(words) - cut])))
            i += 1
    rng.shuffle(found)
    df = spark.createDataFrame(found, "doc_id long, text string")
    out = j.ngram_components(df, n=3, percent=90).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in out) == sorted((a, b, c or -1) for a, b, c in brute(found, 3, 90))


def test_sketches_bound_the_symmetric_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        a = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[15:], rng.integers(0, 2**64, 10, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert np.count_nonzero(j.block_keys(a, 3, 40) != j.block_keys(b, 3, 40)) <= apart
        words = j._folded([j.bit_sketch(a, 90), j.bit_sketch(b, 90)])
        assert int(np.bitwise_count(words[0] ^ words[1]).sum()) <= apart


def test_one_of_each_stays(spark):
    df = frame(spark)
    kept = j.keep_one_of_each(df)
    assert kept.columns == df.columns
    want = brute(rows(), 5, 80)
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert ids == sorted({i for i, _, c in want if i == c or i == -1})
    assert j.keep_one_of_each(empty(spark)).collect() == []


def test_empty_tables(spark):
    assert j.ngram_components(empty(spark)).collect() == []
    only = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert sorted(tuple(r) for r in j.ngram_components(only).collect()) == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]


def brute_links(found, n, percent):
    s = sets_of(found, n)
    close = lambda a, b: bool(s[a] and s[b]) and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])
    return sorted((r[0] or -1, sum(close(k, o) for o in range(len(s)) if o != k)) for k, r in enumerate(found))


@pytest.mark.parametrize(("run", "run_bytes", "columns"), [(1024, 8 << 20, 4096), (3, 8 << 20, 7), (1024, 3000, 4096)])
def test_all_links_are_counted(spark, monkeypatch, run, run_bytes, columns):
    """Links inside a component too, whole or in runs; here near copies of one another are most of the links."""
    monkeypatch.setattr(j, "RUN", run)
    monkeypatch.setattr(j, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(j, "COLUMNS", columns)
    for n, percent in [(3, 90), (5, 80)]:
        out = j.ngram_links(frame(spark), n=n, percent=percent).collect()
        want = brute_links(rows(), n, percent)
        assert sum(c for _, c in want) > 100
        assert sorted((r["doc_id"] or -1, r["n_links"]) for r in out) == want
    assert j.ngram_links(empty(spark)).collect() == []


def test_op2_links_a_chain_by_its_pairs(spark, tmp_path):
    """Of near copies all pairs count, not only those that join components; a copy counts as a row; a chain's ends don't link."""
    words = [f"w{k}" for k in range(200)]
    found = [(1, " ".join(words)), (2, " ".join(words[2:])), (3, " ".join(words[:-4])), (4, " ".join(words[10:-12])), (5, " ".join(words))]
    spark.createDataFrame(found, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = j.op2_ngram_join(spark, str(tmp_path)).collect()
    want = brute_links(found, 3, 90)
    assert sorted((r["doc_id"], r["n_links"]) for r in out) == want
    assert dict(want) == {1: 3, 2: 3, 3: 4, 4: 1, 5: 3}


def test_one_of_each_by_row_where_ids_repeat(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(100)) for x in "abcd")
    found = [(3, a), (9, a + " more"), (9, b), (9, c), (12, c + " more"), (15, c), (None, d), (None, d + " more"), (None, b + " more"), (None, None), (None, ""), (20, None)]
    out = j.keep_one_of_each(spark.createDataFrame(found, "doc_id long, text string").repartition(3)).collect()
    got = [(r["doc_id"], r["text"]) for r in out]
    assert sorted(got[k] for k in range(len(got)) if got[k][0] is not None and got[k][1]) == [(3, a), (9, b), (9, c)]
    assert len([t for i, t in got if i is None and t]) == 1 and {t for i, t in got if i is None and t} <= {d, d + " more"}
    assert sorted(map(repr, [x for x in got if not x[1]])) == ["(20, None)", "(None, '')", "(None, None)"]


def test_salted_join_of_a_hub_equals_the_plain_one(spark):
    pairs = spark.createDataFrame([(0, b) for b in range(1, 700)] + [(a, 900) for a in range(1, 5)] + [(0, 5), (7, 901)], "a long, b long")
    known = spark.createDataFrame([(a, f"x{a}") for a in range(6)], "a long, x string")
    joined = join_salted(pairs, known, "a", "b", pairs, pairs.count())
    assert sorted(joined.select("a", "b", "x").collect()) == sorted(pairs.join(known, "a").select("a", "b", "x").collect())
    nothing = pairs.where("a < 0")
    assert join_salted(nothing, known, "a", "b", nothing, 0).count() == 0
