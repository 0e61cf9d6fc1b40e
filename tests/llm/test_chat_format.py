import hashlib

from pyspark.sql import functions as F

from duonet.llm import chat_format as c

ODD = ["", None, "plain", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "\\", "\\\\|", "<\\|", "<<||", "a\nb", "\\n", "<|im_escaped|>", "<|", "|>", "x<|im_start", "end\\", "é😀", "<|im_end|>\n<|im_start|>assistant\nno"]


def conversations():
    rows, conv = [], 0
    for a in ODD:
        for b in ODD[::3]:
            rows += [(conv, 0, "user", a), (conv, 1, "assistant", b)]
            conv += 1
    rows += [(conv, 0, "user", "x"), (conv, 0, "user", "x"), (conv, 0, "assistant", "tie"), (conv, None, None, "no turn"), (conv + 1, 0, "ro\nle<|im_end|>\\", "t"), (conv + 2, 5, "assistant", "only"), (None, 0, "assistant", "no id")]
    rows += [(conv + 3, k, "assistant" if k % 2 else "user", f"turn {k} \\ <|im_end|>" if k == 130 else f"turn {k}") for k in range(300)]
    return rows


def test_round_trip_and_mask(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, level int").repartition(3)
    out = c.chat_format(df)
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", "loss_mask", "level", c.recovered(F.col("formatted")).alias("back"), c.masked_text(F.col("formatted"), F.col("loss_mask")).alias("masked")).collect()}
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns = [t[2:] for t in sorted(turns)]
        r = got[conv]
        assert [(t["role"], t["text"]) for t in r["back"]] == turns
        assert r["masked"] == "".join(t for role, t in turns if role == "assistant")
        assert len(r["loss_mask"]) == sum(role == "assistant" for role, _ in turns)
        if r["level"] == 0:
            assert r["formatted"] == "".join(f"{c.START}{a}\n{b}{c.END}\n" for a, b in turns)
        else:
            body = r["formatted"][len(c.ESCAPED):]
            assert body.count(c.START) == body.count(c.END) == len(turns)


def test_plain_conversations_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a \\ b <| c"), (1, 1, "assistant", "d")], "conv_id long, turn long, role string, text string")
    assert c.chat_format(df).first()["level"] == 0


def test_registered_query(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r["conv_id"]: r for r in c.op9_chat_format(spark, str(tmp_path)).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nyes\n").hexdigest() and out[1]["n_turns"] == 2
    assert out[-1]["loss_chars"] == len(said) and out[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert out[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_empty_table(spark):
    assert c.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
