"""Collapsing features: by correlation, by knowledge, and both."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duonet.kernels.hclust import complete_linkage
from duonet.operators.stats import correlations


def collapse_by_group(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean of each feature group per sample. groups: (feature_id, feature_group)."""
    return df.join(groups, "feature_id").groupBy("group", "sample_id", "feature_group").agg(F.avg("value").alias("value"))


def co_clustered(clusters: DataFrame) -> DataFrame:
    """clusters: (scope.., group, feature_id, cluster) of two groups. Features that share their cluster in both groups.

    The intersection of two equivalence relations is one, so the classes are the pairs of cluster numbers: an aggregation
    in place of a search for connected components.
    """
    pair = clusters.groupBy("class", "feature_id").agg(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws("=", "group", F.col("cluster").cast("string"))))).alias("both"))
    size = pair.groupBy("class", "both").agg(F.count("*").alias("n"), F.min("feature_id").alias("first"))
    return pair.join(size, ["class", "both"])


def linkage(df: DataFrame, threshold: float) -> DataFrame:
    """(class, group, feature_id, cluster): complete linkage of 1 - |r| cut at 1 - threshold, per class and group."""
    pairs = correlations(df.select("class", "group", "sample_id", "feature_id", "value"), ["class", "group"])
    alone = df.select("class", "group", "feature_id").distinct()
    loops = alone.select("class", "group", F.col("feature_id").alias("feature_a"), F.col("feature_id").alias("feature_b"), F.lit(1.0).alias("r"))

    def cluster(rows: pa.Table) -> pa.Table:
        names = sorted(set(rows.column("feature_a").to_pylist()) | set(rows.column("feature_b").to_pylist()))
        at = {f: k for k, f in enumerate(names)}
        d = np.ones((len(names), len(names)))
        for a, b, r in zip(rows.column("feature_a").to_pylist(), rows.column("feature_b").to_pylist(), rows.column("r").to_pylist(), strict=True):
            if a != b:
                d[at[a], at[b]] = d[at[b], at[a]] = 1.0 if r is None else 1.0 - abs(r)
        labels = complete_linkage(d, 1.0 - threshold + 1e-12)
        n = len(names)
        return pa.table({"class": [rows.column("class")[0].as_py()] * n, "group": [rows.column("group")[0].as_py()] * n, "feature_id": names, "cluster": pa.array(labels, pa.int32())})

    both = pairs.select("class", "group", "feature_a", "feature_b", "r").unionByName(loops)
    return both.groupBy("class", "group").applyInArrow(cluster, "class string, group string, feature_id string, cluster int")


def correlation_groups(df: DataFrame, threshold: float = 0.9, knowledge: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """(feature_id, feature_group, collapsed): features that co-cluster in both groups; others stand alone.

    knowledge: (feature_id, feature_group) restricts clusters to a class.
    """
    classed = df.join(knowledge.withColumnRenamed("feature_group", "class"), "feature_id") if knowledge is not None else df.withColumn("class", F.lit(""))
    found = co_clustered(linkage(classed, threshold))
    nth = F.dense_rank().over(Window.partitionBy("class").orderBy(F.when(F.col("n") >= 2, 0).otherwise(1), "first"))
    name = F.concat(F.when(F.col("class") != "", F.concat(F.lit("knowledge: "), F.col("class"), F.lit("-correlation: "))).otherwise(prefix), F.lit("group"), nth.cast("string"))
    return found.select("feature_id", F.when(F.col("n") >= 2, name).otherwise(F.col("feature_id")).alias("feature_group"), (F.col("n") >= 2).alias("collapsed"))
