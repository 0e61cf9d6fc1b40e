"""Incremental statistics: sums that let node lists and correlations follow a stream of new samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_moments(stream: DataFrame) -> DataFrame:
    """group, feature_id, n, sum, sum of squares of a (streaming) long table; complete or update mode."""
    return stream.groupBy("group", "feature_id").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))


def moments_to_stats(moments: DataFrame) -> DataFrame:
    """mean and sample variance from the sums."""
    n = F.col("n").cast("double")
    return moments.select("group", "feature_id", "n", (F.col("s") / F.nullif(n, F.lit(0.0))).alias("mean"), ((F.col("ss") - F.col("s") * F.col("s") / F.nullif(n, F.lit(0.0))) / F.nullif(n - 1, F.lit(0.0))).alias("var"))
