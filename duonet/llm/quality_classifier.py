r"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of statistics, transformed so that a class looks roughly normal. Labelled rows are summed per
class into counts, sums and products inside Spark, so any number of labels costs the same on the driver; the class
covariances shrink towards their diagonal and towards a small multiple of the identity, and the score of a document is the
logistic function of the difference of the two log densities, each a Mahalanobis distance through the class's Cholesky
factor plus its log determinant. The factors and their triangular inverses are computed once and travel with the scoring
function, so that a score is a product. Class priors are equal
by default, so that the share of labels does not move the threshold.

Defined results: a null text counts as empty, and an empty text has a score like any other. Labels other than 0 and 1, and
null labels, are not learned from. With fewer than two rows of a class, the class takes the pooled moments; without any
labels every score is 0.5. Every input row gives one row, repeated rows included; an empty table gives none. Repeated label
rows count once for each. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from duonet.llm._common import cut, extended, map_rows, small, table, texts_of
from duonet.llm.quality_rules import Document, UPPER

#: The statistics, in order.
FEATURES = ("log_words", "word_length", "symbols", "exclamations", "capitals", "digits", "repeated_lines", "repeated_words", "distinct_words", "line_length")

#: Statistics are clipped to this many of the pooled standard deviations around the pooled mean.
CLIP = 6.0
SHRINK_TO_DIAGONAL, RIDGE = 0.1, 0.05


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text; all finite, for empty texts too."""
    d = Document(text)
    n, size = d.n_words, max(len(text), 1)
    per_word = lambda x: math.log1p(10.0 * x / max(n, 1))
    distinct = len(set(d.words))
    return [
        math.log1p(n),
        math.log1p(d.word_chars / max(n, 1)),
        per_word(d.n_symbols),
        per_word(text.count(b"!")),
        math.sqrt(d.count_of(UPPER) / size),
        math.sqrt(d.count_of(b"0123456789") / size),
        math.sqrt(d.n_dup_lines / max(len(d.lines), 1)),
        math.sqrt(d.n_repeat_words / max(n, 1)),
        math.log((distinct + 1.0) / (n + 1.0)),
        math.log1p(n / max(len(d.lines), 1)),
    ]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs: id and text. The rows with an added array column __stats."""
    at = docs.columns.index(text_col)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = pa.array([statistics(t) for t in texts_of(batch.column(at))], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns, stats], names=[*batch.schema.names, "__stats"])

    return map_rows(docs, add, extended(docs.schema, __stats=ArrayType(DoubleType())))


@dataclass(frozen=True)
class Discriminant:
    """Two class densities over standardised, clipped statistics."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    inverses: np.ndarray
    log_dets: np.ndarray
    log_prior: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(stats), 0.5)
        x = np.clip((stats - self.center) / self.scale, -CLIP, CLIP)
        logs = []
        for mean, inverse, log_det in zip(self.means, self.inverses, self.log_dets, strict=True):
            z = inverse @ (x - mean).T
            logs.append(-0.5 * (np.sum(z * z, axis=0) + log_det))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1] - self.log_prior, -500, 500)))


def moments(labelled: DataFrame, label: Column, center: np.ndarray | None = None, scale: np.ndarray | None = None) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: count, sum and sum of products of the statistics, added up inside Spark."""
    d = len(FEATURES)

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, d)
            if center is not None:
                x = np.clip((x - center) / scale, -CLIP, CLIP)
            y = np.array(batch.column(0).to_pylist())
            for k in np.unique(y):
                z = x[y == k]
                total[int(k)] = total.get(int(k), 0) + np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        for k, v in total.items():
            yield pa.RecordBatch.from_pydict({"label": pa.array([k] * len(v), pa.int32()), "at": pa.array(range(len(v)), pa.int32()), "v": v})

    parts = labelled.select(label.cast("int").alias("label"), "__stats").mapInArrow(partial, "label int, at int, v double")
    rows = parts.groupBy("label", "at").agg(F.sum("v").alias("v")).collect()  # at most 2 classes x (1 + d + d * d) numbers
    out = {}
    for k in {r["label"] for r in rows}:
        v = np.zeros(1 + d + d * d)
        for r in rows:
            if r["label"] == k:
                v[r["at"]] = r["v"]
        out[k] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


def fit(labelled: DataFrame, label: str, prior: float = 0.5) -> Discriminant:
    """labelled: rows with __stats and a 0/1 label."""
    d = len(FEATURES)
    usable = labelled.where(F.col(label).isin(0, 1))
    raw = moments(usable, F.col(label))
    n = sum(m[0] for m in raw.values())
    if not n:
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((0, d)), np.zeros((0, d, d)), np.zeros((0, d, d)), np.zeros(0), 0.0)
    center = sum(m[1] for m in raw.values()) / n
    scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in raw.values())) / n - center**2, 1e-12))
    scale = np.where(scale < 1e-6, 1.0, scale)
    by_class = moments(usable, F.col(label), center, scale)
    pooled = (n, sum(m[1] for m in by_class.values()), sum(m[2] for m in by_class.values()))
    means, factors, dets = [], [], []
    for k in (0, 1):
        c, s, p = by_class.get(k, pooled)
        if c < 2:
            c, s, p = pooled
        mean = s / c
        cov = p / c - np.outer(mean, mean)
        cov = (1 - SHRINK_TO_DIAGONAL) * cov + SHRINK_TO_DIAGONAL * np.diag(np.diag(cov)) + RIDGE * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(factor)
        dets.append(2 * np.sum(np.log(np.diag(factor))))
    return Discriminant(center, scale, np.array(means), np.array(factors), np.array([np.tril(np.linalg.inv(f)) for f in factors]), np.array(dets), math.log(prior / (1 - prior)))


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """Replaces __stats by __score."""
    at = rows.columns.index("__stats")
    keep = [f for f in rows.schema.fields if f.name != "__stats"]

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column(at).to_pylist(), dtype=float).reshape(-1, len(FEATURES))
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        return pa.RecordBatch.from_arrays([*columns, pa.array(model.score(x))], names=[*(f.name for f in keep), "__score"])

    return map_rows(rows, add, extended(StructType(keep), __score=DoubleType()))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fits on the labelled rows that are not held out. stats: id and __stats."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).where(~held_out(F.col("__id")))
    return fit(stats.join(known, F.col(id_col) == F.col("__id")).select("__stats", "__label"), "__label")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher: label 1 likelier), predicted."""
    stats = cut(with_statistics(docs.select(id_col, text_col), text_col).select(id_col, "__stats"))
    out = scored(stats, learn(stats, labels, id_col, label_col))
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def keep_by_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """The rows whose score reaches the threshold, all their columns unchanged.

    Only the labelled documents' statistics are gathered for the fit; the filter computes each text's own in the same pass.
    """
    known = labels.select(F.col(id_col).alias("__id")).where(~held_out(F.col("__id"))).distinct()
    trained = with_statistics(docs.select(id_col, text_col).join(small(known), F.col(id_col) == F.col("__id"), "left_semi"), text_col).select(id_col, "__stats")
    model = learn(cut(trained), labels, id_col, label_col)
    at = docs.columns.index(text_col)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in texts_of(batch.column(at))], dtype=float).reshape(-1, len(FEATURES))
        return batch.filter(pa.array(model.score(x) >= threshold))

    return map_rows(docs, keep, docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
SQL: dict[str, str] = {}
