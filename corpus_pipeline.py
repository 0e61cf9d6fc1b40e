"""The corpus pipeline: documents through four filters and into packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of documents:

1. quality classifier: documents scored under 0.5 go (learned from the labels that are not held out);
2. quality rules: documents that a rule rejects go;
3. n-gram Jaccard join (five words, 0.8): of each group of near copies the one with the least doc_id stays;
4. substring dedup: words covered by a 35-word window that starts elsewhere too are cut, n_chars follows; no row goes;
5. best-fit packing: one row per piece of a document with its sequence.

Defined results: a null or empty text is scored like any other, then rejected by the word-count rule; other columns hold any
values and pass unchanged. Of rows with the least id of their group and equal texts one stays; a null id comes last. Repeated
rows are judged and packed each, where they stay. Empty tables give empty tables. Extra columns of documents, whatever their
names, pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duonet.llm._common import cut, free_name
from duonet.llm.ngram_join import keep_one_of_each
from duonet.llm.packing import best_fit_packing
from duonet.llm.quality_classifier import keep_by_quality
from duonet.llm.quality_rules import keep_by_rules
from duonet.llm.substring_dedup import remove_repeats
from duonet.shipping import importable


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return keep_by_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return keep_by_rules(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return keep_one_of_each(docs, n=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    words, gone = free_name(docs.columns, "n_words"), free_name(docs.columns, "n_removed")
    cut_docs = remove_repeats(docs, counts=(words, gone))
    length = F.when(F.col(gone) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut_docs.withColumn("n_chars", length).drop(words, gone)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", packing),
]

#: The classifier is learned, so SQL can't express the pipeline; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
