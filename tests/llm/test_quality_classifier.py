import zlib

import numpy as np

from duonet.llm import quality_classifier as q
from tests.llm.corpus import empty, frame, prose, rows


def labels(spark, found):
    return spark.createDataFrame(found, "doc_id long, quality int, toxic int, score string")


def test_scores_separate_and_generalise(spark):
    import random

    rng = random.Random(3)
    docs, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(["spam!!"] * rng.randint(20, 60)) if bad else prose(rng, rng.randint(30, 90))
        docs.append((i, text))
        marks.append((i, int(not bad), 0, "x"))
    out = q.quality_scores(spark.createDataFrame(docs, "doc_id long, text string"), labels(spark, marks)).collect()
    assert len(out) == 400
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.97


def test_density_difference_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    d = len(q.FEATURES)
    x = [rng.normal(0, 1, (200, d)), rng.normal(1, 2, (300, d))]
    df = spark.createDataFrame([(v.tolist(), k) for k in (0, 1) for v in x[k]], "__stats array<double>, label int")
    m = q.fit(df, "label")
    every = np.concatenate(x)
    z = [np.clip((v - every.mean(0)) / every.std(0), -q.CLIP, q.CLIP) for v in x]
    test = rng.normal(0.5, 1.5, (50, d))
    t = np.clip((test - every.mean(0)) / every.std(0), -q.CLIP, q.CLIP)
    logs = []
    for v in z:
        c = np.cov(v.T, bias=True)
        c = (1 - q.SHRINK_TO_DIAGONAL) * c + q.SHRINK_TO_DIAGONAL * np.diag(np.diag(c)) + q.RIDGE * np.eye(d)
        e = t - v.mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e) + np.linalg.slogdet(c)[1]))
    assert np.allclose(m.score(test), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def test_hard_rows(spark):
    df = frame(spark)
    some = labels(spark, [(r[0], k % 2, 0, "x") for k, r in enumerate(rows()[:30])] + [(None, 1, 0, "x"), (4, None, 0, "x"), (7, 5, 0, "x")])
    out = q.quality_scores(df, some).collect()
    assert len(out) == len(rows()) and all(np.isfinite(r["score"]) for r in out)
    none = q.quality_scores(df, labels(spark, []).limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    one_class = q.quality_scores(df, labels(spark, [(r[0], 1, 0, "x") for r in rows()[:20]])).collect()
    assert all(np.isfinite(r["score"]) for r in one_class)
    assert q.quality_scores(empty(spark), some).collect() == []
    kept = q.keep_by_quality(df, some)
    assert kept.columns == df.columns
    score = {r["doc_id"]: r["score"] for r in out}
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r[0] or -1 for r in rows() if score[r[0]] >= 0.5)


def test_whole_query_on_held_out_labels(spark):
    """On documents whose labels it did not learn from."""
    out = q.op3_quality_classifier(spark, "/root/testdata/sf0.01").where("held_out").select("doc_id", "score", "predicted")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    found = out.join(marks, "doc_id").collect()
    good = [r["score"] for r in found if r["quality"] == 1]
    bad = [r["score"] for r in found if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(good) > 30 and len(bad) > 10 and auc > 0.99
    assert np.mean([r["predicted"] == r["quality"] for r in found]) > 0.97


def test_clashing_and_nested_columns(spark):
    df = spark.createDataFrame([(i, "plain words " * 20 if i % 2 else "### !! " * 30, "x", (i,), "y") for i in range(60)], "doc_id long, text string, `__stats` string, `a b.c` struct<`x y`:int>, `__id` string")
    out = q.keep_by_quality(df, labels(spark, [(i, i % 2, 0, "x") for i in range(60)]))
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["a b.c"]["x y"], r["__stats"]) for r in out.collect()) == [(i, i, "x") for i in range(60) if i % 2]
