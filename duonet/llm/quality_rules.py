"""Quality rules as a short-circuit cascade.

Every rule reads a few statistics of a document, computed when first asked for. On a bounded sample each rule's cost (time
to compute what it needs) and selectivity (share rejected) are measured; the cascade then runs the rules in order of
rejection per cost and stops at a document's first rejection. The order changes the time only: a document is kept when no
rule rejects it, in whatever order they run. The sample is the rows of the least hashes, wherever they lie in the table.
Words in repeated windows are found by 64-bit hashes that are compared within one text only (n words give about n**2 / 2**65
false windows); they are not compared word by word.

Defined results: a null text counts as empty; an empty text has no words and is rejected by the word-count rule. Every
input row gives one row, repeated rows included; an empty table gives none. Only the id and text columns are read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from duonet.llm._common import GOLDEN, map_rows, table, texts_of

#: Bound of the sample on which costs and selectivities are measured; it never changes a verdict.
SAMPLE_ROWS = 400

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#*$%&|<>"


class Document:
    """Statistics of one text, each computed when first asked for."""

    def __init__(self, text: bytes) -> None:
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        raw = np.frombuffer(self.text, np.uint8)
        return sum(map(len, self.words)) - int(np.count_nonzero((raw & 0xC0) == 0x80))

    def count_of(self, characters: bytes) -> int:
        return len(self.text) - len(self.text.translate(None, characters))

    @cached_property
    def n_symbols(self) -> int:
        return self.count_of(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 6:
            return 0
        h = np.fromiter(map(hash, self.words), np.int64, n).view(np.uint64)  # compared within this text only
        windows = np.zeros(n - 4, np.uint64)
        for k in range(5):
            windows = windows * GOLDEN + h[k : n - 4 + k]
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return 0
        starts = np.flatnonzero(np.isin(windows, twice))
        edges = np.zeros(n + 1, np.int32)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + 5, -1)
        return int(np.count_nonzero(np.cumsum(edges[:n])))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


BASE_RULES = (
    Rule("few_words", lambda d: d.n_words < 10),
    Rule("repeated_words", lambda d: 100 * d.n_repeat_words > 20 * d.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("exclamations", lambda d: 10 * d.text.count(b"!") > d.n_words),
    Rule("capitals", lambda d: 100 * d.count_of(UPPER) > 40 * d.word_chars),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("repeated_lines", lambda d: 100 * d.n_dup_lines > 40 * len(d.lines)),
)


def rule_order(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, measured by one task on at most sample_rows rows."""
    rules = list(rules)

    def measure(batches):
        cost, rejected = np.zeros(len(rules)), np.zeros(len(rules))
        for batch in batches:
            for text in texts_of(batch.column(0)):
                for k, rule in enumerate(rules):
                    doc = Document(text)
                    start = time.perf_counter()
                    rejected[k] += rule.rejects(doc)
                    cost[k] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict({"rule": np.arange(len(rules)), "cost": cost, "rejected": rejected})

    hashed = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    least = hashed.select("hash").orderBy("hash").limit(sample_rows).agg(F.max("hash")).first()[0]  # numbers only, no texts
    sample = hashed.where(F.col("hash") <= F.lit(least if least is not None else 0)).select("text").limit(sample_rows)
    rows = sample.mapInArrow(measure, "rule long, cost double, rejected double").collect()  # a row a rule
    gain = [0.0] * len(rules)
    spent = [0.0] * len(rules)
    for r in rows:
        gain[r["rule"]] += r["rejected"]
        spent[r["rule"]] += r["cost"]
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain[k] / max(spent[k], 1e-9), k))]


def first_rejection(doc: Document, ordered: Sequence[Rule]) -> str | None:
    for rule in ordered:
        if rule.rejects(doc):
            return rule.name
    return None


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    ordered = rule_order(docs, rules, text_col)
    schema = StructType([docs.schema[id_col], *(StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")}
        for text in texts_of(batch.column(1)):
            doc = Document(text)
            failed = any(rule.rejects(doc) for rule in BASE_RULES)
            for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
                cols[name].append(getattr(doc, name))
            cols["base_failed"].append(failed)
            cols["kept"].append(not failed and first_rejection(doc, ordered) is None)
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols.values())], names=[id_col, *cols])

    return map_rows(docs.select(id_col, text_col), judge, schema)


def keep_by_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, all their columns unchanged; here a document's first rejection ends its work."""
    ordered = rule_order(docs, rules, text_col)
    at = docs.columns.index(text_col)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([first_rejection(Document(t), ordered) is None for t in texts_of(batch.column(at))], pa.bool_()))

    return map_rows(docs, keep, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) > 4),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(w[i:i + 4], ' '))) AS c FROM g),
rw AS (SELECT doc_id, count(DISTINCT p) AS n_rep FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h WHERE c > 1) GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(t) - length(replace(t, '!', '')) AS bangs, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals
  FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rw USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 10 * bangs > n_words OR 100 * capitals > 40 * word_chars OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words OR 100 * n_dup_lines > 40 * n_lines) AS kept
FROM s
"""

QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL = {"op6_quality_rules": OP6_SQL}
