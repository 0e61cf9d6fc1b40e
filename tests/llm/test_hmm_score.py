import itertools
import math
import zlib
from collections import Counter

import numpy as np

from duonet.llm import hmm_score as h
from tests.llm.corpus import empty, frame, rows


def test_base_counts_match_brute_force(spark):
    out = h.hmm_scores(frame(spark), rounds=2, states=3).collect()
    words = [(r[0], (r[1] or "").encode().lower().split()) for r in rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for i, w in words:
        if not held(i):
            c.update(w)
            c["END"] += 1
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, held(i), len(w) + 1, sum(c[x] > 0 for x in [*w, "END"]), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, "END"]), 6)) for i, w in words)
    got = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def chain(k, symbols, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, a: x / x.sum(a, keepdims=True)
    return h.Chain(norm(rng.random(k), 0), norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((symbols, k)), 0))


def path_sum(c, seq, first):
    k = len(c.first)
    total = 0.0
    for states in itertools.product(range(k), repeat=len(seq)):
        p = first[states[0]] * c.emit[seq[0], states[0]]
        for t in range(1, len(seq)):
            p *= c.move[states[t - 1], states[t]] * c.emit[seq[t], states[t]]
        total += p
    return total


def test_forward_recursion_is_exact():
    c = chain(3, 5)
    seqs = [[0, 1, 4, 2], [3], [2, 2, 2, 2, 2, 1], [4, 0]]
    flat = np.array([x for s in seqs for x in s])
    lengths = np.array([len(s) for s in seqs])
    got = h.log10_likelihoods(c, flat, np.cumsum(lengths) - lengths, lengths)
    assert np.allclose(got, [math.log10(path_sum(c, s, c.first)) for s in seqs])


def test_expected_counts_match_brute_force():
    c = chain(2, 4, 1)
    seqs, opens = [[0, 1, 3], [2], [3, 3, 0, 1]], np.array([True, False, True])
    flat = np.array([x for s in seqs for x in s])
    lengths = np.array([len(s) for s in seqs])
    first, again, move, emit, ll = h.expected_counts(c, flat, np.cumsum(lengths) - lengths, lengths, opens)
    w_first, w_again, w_move, w_emit, w_ll = np.zeros(2), np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for s, o in zip(seqs, opens, strict=True):
        start = c.first if o else c.again
        total = path_sum(c, s, start)
        w_ll += math.log(total)
        for states in itertools.product(range(2), repeat=len(s)):
            p = start[states[0]] * c.emit[s[0], states[0]]
            for t in range(1, len(s)):
                p *= c.move[states[t - 1], states[t]] * c.emit[s[t], states[t]]
            p /= total
            (w_first if o else w_again)[states[0]] += p
            for t, x in enumerate(s):
                w_emit[x, states[t]] += p
                if t:
                    w_move[states[t - 1], states[t]] += p
    assert np.allclose(first, w_first) and np.allclose(again, w_again) and np.allclose(move, w_move) and np.allclose(emit, w_emit) and np.isclose(ll, w_ll)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(4)
    flat = np.concatenate([rng.integers(0, 5, 50) + 5 * (k % 2) for k in range(40)])
    lengths = np.full(40, 50)
    starts = np.cumsum(lengths) - lengths
    shares = np.full(10, 0.1)
    c, last = h.start_chain(shares, 2, 0), -np.inf
    for _ in range(8):
        first, again, move, emit, ll = h.expected_counts(c, flat, starts, lengths, np.ones(40, bool))
        assert ll > last - 1e-6
        last, c = ll, h.improve(c, shares, first, again, move, emit)
    assert last / len(flat) > math.log(1 / 10) + 0.5


def test_model_is_a_distribution(spark):
    """Over all one-word texts of the known words and one unknown word per class, and the empty text: no more than 1."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "b", "a a c", "c b a", "d"])], "doc_id long, text string")
    probe = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["", "a", "b", "c", "d"])], "doc_id long, text string")
    out = h.hmm_scores(docs.unionByName(probe), held_out=lambda i: i >= 100, rounds=2, states=2).where("doc_id >= 100").collect()
    assert 0 < sum(10 ** r["score"] for r in out) <= 1 + 1e-9


def test_no_training_rows_and_empty_table(spark):
    out = h.hmm_scores(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), held_out=lambda i: True).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert h.hmm_scores(empty(spark)).collect() == []


def test_symbols_grow_with_the_vocabulary():
    small, large = (h.choose_symbols({1: n, 10: n // 10, 1000: n // 100}) for n in (10_000, 1_000_000))
    assert large.slots > 4 * small.slots and small.classes == small.slots // 4
    found = h.choose_symbols({1: 900, 5: 90, 50: 10})
    assert found.least == 5
    found = h.choose_symbols({1: 90_000, 5: 9_000, 50: 1_000})
    assert found.least == 50 and h.choose_symbols({}).slots == 1024
    counts = np.array([0, 1, 63, 64, 71, 72, 1000, 10**9])
    assert (h.count_bin(counts) <= counts).all() and (h.count_bin(counts) >= counts * 7 // 8).all()


def test_states_tell_words_of_a_class_apart(spark):
    """Two words with the same ends follow different words; symbols of their own let the states learn it, classes don't."""
    docs = [(i, " ".join(["aaxxyyzz bb"] * 20 if i % 2 else ["aaqqyyzz cc"] * 20)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    own = h.hmm_scores(df, held_out=lambda i: i >= 50, states=4, rounds=8).where("held_out").agg({"score": "sum"}).first()[0]
    old, h.LEAST_OWN = h.LEAST_OWN, 10**9
    try:
        classes = h.hmm_scores(df, held_out=lambda i: i >= 50, states=4, rounds=8).where("held_out").agg({"score": "sum"}).first()[0]
    finally:
        h.LEAST_OWN = old
    assert own > classes + 50


def test_whole_query_beats_the_base_on_held_out_texts(spark):
    out = h.op5_hmm_score(spark, "/root/testdata/sf0.01").where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert out["sum(score)"] / out["sum(n_tokens)"] > -3.56 > out["sum(base_score)"] / out["sum(n_tokens)"]
