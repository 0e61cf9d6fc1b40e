import corpus_pipeline as c
from duonet.llm import ngram_join, packing, quality_classifier, quality_rules, substring_dedup
from tests.llm.corpus import SCHEMA, prose, rows
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_substring_dedup import brute as cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, path):
    import random

    rng = random.Random(9)
    found = [r for r in rows() if r[0] is not None][:-1]
    extra = [(1000 + i, " ".join(["junk!!"] * 40) if i % 2 else prose(rng, 60)) for i in range(80)]
    found += [(i, t, "en", None, len(t), *found[0][5:]) for i, t in extra]
    spark.createDataFrame(found, SCHEMA).select(*COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1 - i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return [r[:5] for r in found]


def test_stages_match_brute_force(spark, tmp_path):
    docs = write(spark, tmp_path)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, df, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        got = out.collect()
        ids = sorted(r["doc_id"] for r in got)
        if name == "quality_classifier":
            score = {r["doc_id"]: r["score"] for r in quality_classifier.quality_scores(df, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
            docs = [d for d in docs if score[d[0]] >= 0.5]
        elif name == "quality_rules":
            docs = [d for d in docs if quality_rules.first_rejection(quality_rules.Document((d[1] or "").encode()), quality_rules.RULES) is None]
        elif name == "ngram_jaccard_join":
            stay = {i for i, _, g in groups(docs, 5, 80) if i == g}
            docs = [d for d in docs if d[0] in stay]
        elif name == "substring_dedup":
            want = cut(docs, 35)
            assert sorted((r["doc_id"], b" ".join((r["text"] or "").encode().split()).decode()) for r in got) == sorted((i, t) for i, _, _, t in want)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
        else:
            assert {r["doc_id"] for r in got} == {d[0] for d in docs}
            break
        assert ids == sorted(d[0] for d in docs), name
        assert len(docs) > 10
        df = out


def test_run_on_hard_tables(spark, tmp_path):
    write(spark, tmp_path)
    assert c.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert c.run(spark, f"{tmp_path}/none").count() == 0


def test_modules_are_used():
    assert [n for n, _ in c.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    assert c.ORACLE_SQL is None and packing and substring_dedup and ngram_join
