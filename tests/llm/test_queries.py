"""The registered queries that SQL can't express, on written tables, against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from duonet.llm import registry
from tests.llm.corpus import SCHEMA, frame, prose, rows
from tests.llm.test_embedding_dedup import brute as brute_links
from tests.llm.test_ngram_join import brute as brute_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    frame(spark).write.parquet(f"{path}/documents.parquet")
    return path


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_op2(spark, folder):
    out = registry.QUERIES["op2_ngram_join"](spark, folder).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in out) == brute_groups(rows(), 3, 90)


def test_op3(spark, tmp_path):
    import random

    rng = random.Random(0)
    docs = [(i, " ".join(["###"] * 30) if i % 3 == 0 else prose(rng, 50), *rows()[0][2:]) for i in range(150)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = registry.QUERIES["op3_quality_classifier"](spark, str(tmp_path)).collect()
    assert len(out) == 150 and all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in out)


def test_op4(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 8))
    found = [(k, (base[k % 20] + rng.normal(size=8) * 0.02).tolist()) for k in range(90)] + [(90, None)]
    spark.createDataFrame([(i, v, 0) for i, v in found], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = registry.QUERIES["op4_embedding_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out) == brute_links(found, 0.95)


def test_op5(spark, folder):
    out = registry.QUERIES["op5_hmm_score"](spark, folder).collect()
    c = Counter()
    for i, t, *_ in rows():
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            c.update((t or "").encode().lower().split())
            c["END"] += 1
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for i, t, *_ in rows():
        words = [*(t or "").encode().lower().split(), "END"]
        want[i].append((len(words), sum(c[w] > 0 for w in words), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), 6)))
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append((r["n_tokens"], r["n_known"], round(r["base_score"], 6)))
        assert r["train_tokens"] == n and r["score"] < 0
    assert got == want


def test_op10(spark, folder):
    out = registry.QUERIES["op10_best_fit_packing"](spark, folder).collect()
    got, want, bins = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in out:
        got[r["doc_id"]] += r["length"]
        bins[r["bin_id"]].append(r)
    for i, t, *_ in rows():
        want[i] += len((t or "").encode().split()) + 1
    assert got == want
    assert all(sum(r["length"] for r in b) == b[0]["bin_used"] <= b[0]["capacity"] for b in bins.values())
