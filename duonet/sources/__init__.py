"""Readers into the canonical long table (assay, group, sample_id, feature_id, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read.schema(schema) if schema else spark.read
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def from_long(df: DataFrame, sample: str, feature: str, value: str, group: str, assay: str = "input_data") -> DataFrame:
    return df.select(F.lit(assay).alias("assay"), F.col(group).cast("string").alias("group"), F.col(sample).cast("string").alias("sample_id"), F.col(feature).cast("string").alias("feature_id"), F.col(value).cast("double").alias("value"))


def from_wide(df: DataFrame, sample: str, group: str, features: list[str] | None = None, assay: str = "input_data") -> DataFrame:
    """One row per sample, one column per feature."""
    features = features or [c for c in df.columns if c not in (sample, group)]
    plain = df.select(F.col(sample).alias("__s"), F.col(group).alias("__g"), *(F.col(f).cast("double").alias(f) for f in features))
    return from_long(plain.unpivot(["__s", "__g"], features, "__f", "__v"), "__s", "__f", "__v", "__g", assay)


def from_triple(assays: DataFrame, col_data: DataFrame, row_data: DataFrame, group: str, pseudo_count: float = 1.0, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """assays: (assay, feature_id, sample_id, value); counts get a pseudo-count. Returns (long, samples, features).

    columns: the feature columns that are taken over (all if None).
    """
    labels = col_data.select("sample_id", F.col(group).cast("string").alias("group"))
    long = assays.join(labels, "sample_id")
    value = F.when(F.col("assay") == "counts", F.col("value") + F.lit(pseudo_count)).otherwise(F.col("value"))
    long = long.select("assay", "group", F.col("sample_id").cast("string").alias("sample_id"), F.col("feature_id").cast("string").alias("feature_id"), value.cast("double").alias("value"))
    kept = row_data if columns is None else row_data.select("feature_id", *(c for c in columns if c in row_data.columns))
    return long, col_data, kept
