import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from duonet.llm import bpe
from tests.llm.corpus import empty, frame, rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(spark):
    enc = encoding()
    vocabulary = bpe.read_vocabulary(PATH)
    odd = [(900 + i, t, *rows()[0][2:]) for i, t in enumerate(["it's  we'll\n\n x", "\x00\x00 a", " lead", "trail ", "123 456", "　x", "a\r\nb", "'S's", "😀😀", "é" * 3000])]
    df = frame(spark).unionByName(spark.createDataFrame(odd, frame(spark).schema))
    for out in (bpe.bpe_decode(bpe.bpe_encode(df, vocabulary, public_tokenizers.PATTERN), vocabulary), bpe.bpe_encode(df, vocabulary, public_tokenizers.PATTERN, decode=True)):
        got = sorted((r["doc_id"] or -1, r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in out.collect())
        want = []
        for r in [*rows(), *odd]:
            ids = enc.encode_ordinary(r[1] or "")
            want.append((r[0] or -1, len(ids), np.array(ids, "<u4").tobytes(), (r[1] or "").encode()))
        assert got == sorted(want)


def test_registered_query(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in bpe.op7_byte_bpe(spark, str(tmp_path)).collect()}
    enc = encoding()
    for r in rows():
        ids = np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes()
        assert out[r[0]]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert out[r[0]]["decoded_sha256"] == hashlib.sha256((r[1] or "").encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.bpe_encode(empty(spark), bpe.read_vocabulary(PATH), public_tokenizers.PATTERN).collect() == []


def test_decoding_keeps_clashing_columns(spark):
    vocabulary = bpe.read_vocabulary(PATH)
    ids = np.array(encoding().encode_ordinary("one two"), "<u4").tobytes()
    df = spark.createDataFrame([(1, bytearray(ids), "a", (3,)), (2, None, "b", (4,))], "doc_id long, ids binary, decoded string, `a b.c` struct<`x y`:int>")
    out = bpe.bpe_decode(df, vocabulary)
    assert out.columns == ["doc_id", "ids", "decoded", "a b.c", "decoded_"]
    assert sorted((r["doc_id"], r["decoded"], bytes(r["decoded_"]), r["a b.c"]["x y"]) for r in out.collect()) == [(1, "a", b"one two", 3), (2, "b", b"", 4)]


def test_texts_are_read_once(spark, tmp_path):
    """Buckets and chunks share one exchange."""
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    out = bpe.op7_byte_bpe(spark, str(tmp_path))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and final.count("FlatMapCoGroupsInArrow") == 1
