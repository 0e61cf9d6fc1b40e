from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from duonet.llm import packing as p
from tests.llm.corpus import empty, frame, rows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_pack_is_sound(lengths):
    lengths = sorted(lengths, reverse=True)
    where, offset, down = p.pack(lengths, (16, 32, 64), 4)
    held = defaultdict(list)
    for n, b, o in zip(lengths, where, offset, strict=True):
        held[b].append((o, n))
    for b, parts in held.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= down[b] and down[b] == min(c for c in (16, 32, 64) if c >= at)


def naive(lengths, permitted, charge, quadratic):
    """The same rule without any index: every open bin is looked at, every trial is played through."""
    cost = lambda c: c + charge + c * c / quadratic
    bins = []  # [size, used]
    where = []
    for k, n in enumerate(lengths):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            best = min(b[0] - b[1] for b in fits)
            where.append(best)
            next(b for b in fits if b[0] - b[1] == best)[1] += n
            continue

        def worth(c, k=k, n=n):
            held, room = n, c - n
            for m in lengths[k + 1:]:
                if m <= room:
                    held, room = held + m, room - m
            return cost(c) / held, c

        c = min((c for c in permitted if c >= n), key=worth)
        bins.append([c, n])
        where.append(None)
    return where, sorted(min(c for c in permitted if c >= b[1]) for b in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sampled_from([(4, 1e9), (2, 100.0), (0, 30.0)]))
def test_pack_is_best_fit(lengths, cost):
    """The room that each piece finds, and the bins at the end, are those of the naive rule."""
    lengths = sorted(lengths, reverse=True)
    permitted = (16, 32, 64)
    where, offset, down = p.pack(lengths, permitted, *cost)
    _, bins = naive(lengths, permitted, *cost)
    assert sorted(down) == bins


def best(lengths, permitted, cost):
    """The least cost over all partitions of the pieces into bins."""

    def go(rest, bins):
        if not rest:
            return sum(cost[min(c for c in permitted if c >= b)] for b in bins)
        out = go(rest[1:], [*bins, rest[0]])
        for k, b in enumerate(bins):
            if b + rest[0] <= permitted[-1] and b not in bins[:k]:
                out = min(out, go(rest[1:], [*bins[:k], b + rest[0], *bins[k + 1:]]))
        return out

    return go(lengths, [])


def test_cost_is_close_to_the_exhaustive_optimum():
    import random

    rng = random.Random(1)
    permitted = (16, 32, 64)
    cost = p.sequence_costs(permitted, 2, 300.0)
    ratios = []
    for _ in range(150):
        lengths = sorted((rng.randint(1, 40) for _ in range(7)), reverse=True)
        _, _, down = p.pack(lengths, permitted, 2, 300.0)
        ratios.append(sum(cost[c] for c in down) / best(lengths, permitted, cost))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.4 and sum(ratios) / len(ratios) < 1.06


def test_sizes_compete():
    """No size wins by its length alone: pieces that fill short bins well go there, others join in long ones."""
    import random

    rng = random.Random(0)
    lengths = sorted((rng.randint(1, 3000) for _ in range(3000)), reverse=True)
    _, _, down = p.pack(lengths, p.LENGTHS)
    counts = {c: down.count(c) for c in p.LENGTHS}
    assert sum(n > len(down) * 0.02 for n in counts.values()) >= 3
    assert sum(lengths) / sum(down) > 0.97
    _, _, only = p.pack(lengths, p.LENGTHS[-1:])
    cost = p.sequence_costs(p.LENGTHS)
    assert sum(cost[c] for c in down) < sum(cost[c] for c in only)


def test_every_document_is_placed_whole(spark):
    out = p.best_fit_packing(frame(spark), permitted=(64, 128, 1024)).collect()
    want = defaultdict(list)
    for r in rows():
        want[r[0]].append(len((r[1] or "").encode().split()) + 1)
    got, bins = defaultdict(int), defaultdict(list)
    for r in out:
        got[r["doc_id"]] += r["length"]
        bins[r["bin_id"]].append(r)
        assert r["start"] == r["piece"] * 1024
    assert dict(got) == {k: sum(v) for k, v in want.items()}
    for parts in bins.values():
        used = sum(r["length"] for r in parts)
        assert all(r["bin_used"] == used <= r["capacity"] for r in parts)
        at = 0
        for r in sorted(parts, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["length"]


def test_empty_table(spark):
    assert p.best_fit_packing(empty(spark)).collect() == []


def test_repeated_rows_have_bins_and_shards_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(p, "SHARD_PIECES", 20)
    long = [(1, "a " * 200)] * 3 + [(None, "b " * 200), (None, "c " * 170), (None, "b " * 200), (2, "d " * 200)]
    short = [(5, "x y")] * 200 + [(None, "x y")] * 200
    df = spark.createDataFrame(long + short, "doc_id long, text string").repartition(3)
    out = p.best_fit_packing(df, permitted=(32, 64)).collect()
    full = [r for r in out if r["length"] == 64]
    assert len(full) == 20 and len({r["bin_id"] for r in full}) == 20
    for i in (5, None):
        shards = [r["bin_id"] >> 32 for r in out if r["doc_id"] == i and r["length"] == 3]
        assert len(shards) == 200 and max(shards.count(s) for s in set(shards)) < 50
    held = {}
    for r in out:
        held.setdefault(r["bin_id"], []).append((r["bin_offset"], r["length"], r["bin_used"], r["capacity"]))
    for parts in held.values():
        at = 0
        for start, length, used, capacity in sorted(parts):
            assert start == at and used <= capacity
            at += length
        assert at == used
    assert sum(r["length"] for r in out) == sum(len(t.split()) + 1 for _, t in long + short)


def test_very_long_texts_of_repeated_and_null_ids(spark):
    """Texts over the longest permitted length under production settings: bins are disjoint and sum up to bin_used."""
    df = spark.createDataFrame([(1, "w " * 9000)] * 2 + [(None, "w " * 9000)] * 2 + [(None, "v " * 8191)], "doc_id long, text string").repartition(2)
    out = p.best_fit_packing(df).collect()
    assert sum(r["length"] for r in out) == 4 * 9001 + 8192
    held = {}
    for r in out:
        held.setdefault(r["bin_id"], []).append(r)
    for parts in held.values():
        assert sum(r["length"] for r in parts) == parts[0]["bin_used"] <= parts[0]["capacity"]
        assert len({r["bin_offset"] for r in parts}) == len(parts)
    assert sum(r["length"] == 8192 for r in out) == 5
