"""Per-group transforms. Statistics are aggregated per (group, feature), a table as small as the features, and joined back:
a window would pull all samples of a feature into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duonet.functions.stat import ratio

KEYS = ["group", "feature_id"]


def log_transform(df: DataFrame) -> DataFrame:
    """Natural log; null where the value is not positive (callers that need positive data check first)."""
    return df.withColumn("value", F.when(F.col("value") > 0, F.ln("value")))


def count_log(df: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """Counts plus a pseudo-count, logged."""
    return log_transform(df.withColumn("value", F.col("value") + F.lit(pseudo)))


def autoscale(df: DataFrame) -> DataFrame:
    """z-score per feature within each group (sample standard deviation); null for features constant up to rounding."""
    stats = df.groupBy(KEYS).agg(F.avg("value").alias("__mean"), F.stddev_samp("value").alias("__sd"))
    sd = F.when(F.col("__sd") > F.lit(1e-13) * F.abs("__mean"), F.col("__sd"))
    return df.join(stats, KEYS).withColumn("value", ratio(F.col("value") - F.col("__mean"), sd)).drop("__mean", "__sd")


def median_range_scale(df: DataFrame) -> DataFrame:
    """(x - median) / largest distance of minimum and maximum from the median, per feature within each group."""
    stats = df.groupBy(KEYS).agg(F.median("value").alias("__mid"), F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    reach = F.greatest(F.abs(F.col("__hi") - F.col("__mid")), F.abs(F.col("__lo") - F.col("__mid")))
    return df.join(stats, KEYS).withColumn("value", ratio(F.col("value") - F.col("__mid"), reach)).drop("__mid", "__lo", "__hi")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("group").agg(F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("feature_id").alias("n_features"), F.count("*").alias("n_values"))


def widen(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Long to wide over a known list of features."""
    return df.groupBy(keys).pivot("feature_id", features).agg(F.first("value"))


def lengthen(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wide to long: all columns but the keys are features."""
    return df.unpivot(keys, [c for c in df.columns if c not in keys], "feature_id", "value")


def subset_features(df: DataFrame, wanted: DataFrame, keep: bool = True) -> DataFrame:
    return df.join(wanted.select("feature_id").distinct(), "feature_id", "left_semi" if keep else "left_anti")


def transpose(df: DataFrame) -> DataFrame:
    """Samples become features and features samples."""
    return df.select(F.col("feature_id").alias("sample_id"), F.col("sample_id").alias("feature_id"), *(c for c in df.columns if c not in ("sample_id", "feature_id")))
