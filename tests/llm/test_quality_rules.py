import re
from collections import Counter

from duonet.llm import quality_rules as q
from tests.llm.corpus import empty, frame, rows


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {p for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_counts_match_brute_force(spark):
    out = q.quality_rules(frame(spark)).collect()
    want = sorted((r[0] or -1, *brute(r[1])) for r in rows())
    got = sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out)
    assert got == want
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_order_does_not_change_the_verdict(spark):
    for _, text, *_ in rows():
        doc = lambda: q.Document((text or "").encode())
        assert (q.first_rejection(doc(), q.RULES) is None) == (q.first_rejection(doc(), q.RULES[::-1]) is None)


def test_rejection_per_cost_comes_first(spark):
    never = q.Rule("never", lambda d: False)
    always = q.Rule("always", lambda d: True)
    assert [r.name for r in q.rule_order(frame(spark), [never, always])] == ["always", "never"]


def test_filter_keeps_rows_whole(spark):
    df = frame(spark)
    kept = q.keep_by_rules(df)
    assert kept.columns == df.columns
    verdict = {r["doc_id"]: r["kept"] for r in q.quality_rules(df).collect()}
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == sorted((r[0] or -1) for r in rows() if verdict[r[0]])


def test_empty_table(spark):
    assert q.quality_rules(empty(spark)).collect() == []
    assert q.keep_by_rules(empty(spark)).collect() == []
