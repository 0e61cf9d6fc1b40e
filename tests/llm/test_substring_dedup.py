import hashlib
from collections import Counter

import numpy as np
import pytest

from duonet.llm import substring_dedup as s
from tests.llm.corpus import empty, frame, rows


def brute(found, window):
    words = [(r[1] or "").encode().split() for r in found]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(found, words, strict=True):
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for p in range(i, i + window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((r[0] or -1, len(w), len(gone), b" ".join(kept).decode()))
    return sorted(out)


@pytest.mark.parametrize("window", [35, 3, 1])
def test_matches_brute_force(spark, window):
    out = s.remove_repeats(frame(spark).select("doc_id", "text"), window=window, layout=False).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["text"] or "") for r in out) == brute(rows(), window)


def test_layout_stays(spark):
    df = frame(spark)
    out = s.remove_repeats(df, window=35)
    assert out.columns == [*df.columns, "n_words", "n_removed"]
    old = {}
    for r in rows():
        old.setdefault(r[0], r[1])
    joined = {r[0]: r[3] for r in brute(rows(), 35)}
    for r in out.collect():
        if not r["n_removed"]:
            assert r["text"] == old[r["doc_id"]]
        assert b" ".join((r["text"] or "").encode().split()).decode() == joined[r["doc_id"] or -1]
        assert r["lang"] == "en" and r["chunk"] == 7


def test_rolling_hash():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**64, 100, dtype=np.uint64)
    got = s.window_hashes(h, 7)
    for i in range(94):
        assert int(got[i]) == sum(int(h[i + k]) * pow(s.BASE, k, 1 << 64) for k in range(7)) % (1 << 64)
    assert len(s.window_hashes(h[:6], 7)) == 0


def test_registered_query(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    out = s.op8_substring_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == [(a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in brute(rows(), 35)]


def test_empty_table(spark):
    assert s.remove_repeats(empty(spark)).collect() == []


def test_clashing_and_nested_columns(spark):
    """Helper names of the operator, names with spaces, dots and quotes, nested fields: all pass unchanged."""
    found = [(i, t, 1, 2, 3, "x", (7, "y"), {"k": 1}) for i, t in enumerate([" ".join(f"w{k}" for k in range(50))] * 2 + ["short", None])]
    kind = "doc_id long, text string, chunk int, bucket int, `__chunk` int, `a b.c` string, s struct<`x y`:int,repeated:string>, m map<string,int>"
    df = spark.createDataFrame(found, kind)
    out = s.remove_repeats(df, counts=("words", "gone"))
    assert out.columns == [*df.columns, "words", "gone"]
    got = sorted(out.collect(), key=lambda r: r["doc_id"])
    assert [r["gone"] for r in got] == [50, 50, 0, 0]
    assert all((r["chunk"], r["bucket"], r["__chunk"], r["a b.c"], r["s"]["x y"], r["s"]["repeated"], r["m"]) == (1, 2, 3, "x", 7, "y", {"k": 1}) for r in got)
    with pytest.raises(ValueError):
        s.remove_repeats(df, counts=("Chunk", "gone"))


@pytest.mark.parametrize("extra", [1, 8])
def test_longer_hashes(spark, monkeypatch, extra):
    monkeypatch.setattr(s, "more_bytes", lambda n: extra)
    out = s.remove_repeats(frame(spark).select("doc_id", "text"), window=5, layout=False).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["text"] or "") for r in out) == brute(rows(), 5)


def test_false_windows_stay_rare():
    for n in (1e6, 1e9, 1e13, 1e16):
        assert n**2 / 2 ** (65 + 8 * s.more_bytes(n)) <= s.FALSE_WINDOWS
    assert s.more_bytes(1e8) == 0


def test_hot_rows_are_dealt_over_chunks(spark, monkeypatch):
    """Repeated rows and null ids that fill many chunks: several chunks share them, and the result is the same."""
    monkeypatch.setattr(s, "CHUNK_BYTES", 5000)
    found = [(1, " ".join(f"w{k}" for k in range(40)))] * 200 + [(None, " ".join(f"v{k}" for k in range(40)))] * 200 + [(k + 2, f"own{k} text") for k in range(20)]
    df = spark.createDataFrame([(i, t, "c") for i, t in found], "doc_id long, text string, chunk string").repartition(3)
    texts, _ = s.dealt_rows(df.select("doc_id", "text"), "doc_id", "text")
    most = texts.groupBy("chunk").count().agg({"count": "max"}).first()[0]
    assert most < 150 and texts.count() == len(found)
    out = s.remove_repeats(df, layout=False).collect()
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["text"] or "") for r in out) == brute(found, 35)
