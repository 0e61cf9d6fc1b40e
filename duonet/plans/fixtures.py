"""Two-group matrices derived from the driver's tables, for the registered queries.

M: sample = supplier, feature = brand, group = line status, value = summed price (complete and positive).
E: sample = vector, feature = dimension, group = label below 5 or not (signed: an already scaled assay).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    m = lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy(F.col("l_linestatus").alias("group"), F.col("l_suppkey").alias("sample_id"), F.col("p_brand").alias("feature_id"))
    return m.agg(F.sum("l_extendedprice").alias("value"))


def matrix_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.when(F.col("label") < 5, "a").otherwise("b").alias("group"), F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("at", "value")).select("group", "sample_id", F.col("at").cast("string").alias("feature_id"), F.col("value").cast("double").alias("value"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, subject, age in days since the start of 2024, feature_id, value, group, endpoint."""
    ev = table(spark, sf_dir, "events")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start)) / F.lit(86400e6)
    group = F.when(F.col("user_id") % 2 == 0, "DM:case").otherwise("DM:control")
    return ev.select("event_id", F.col("user_id").alias("subject"), age.alias("age"), F.col("event_type").alias("feature_id"), "value", group.alias("group"), F.lit(10.0).alias("endpoint"))


M_SQL = """m AS (SELECT l_linestatus AS "group", l_suppkey AS sample_id, p_brand AS feature_id, CAST(sum(l_extendedprice) AS DOUBLE) AS value
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
LM_SQL = M_SQL + """, lm AS (SELECT "group", sample_id, feature_id, ln(value) AS value FROM m)"""
E_SQL = """e AS (SELECT CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS "group", vec_id AS sample_id, CAST(i - 1 AS VARCHAR) AS feature_id, CAST(embedding[i] AS DOUBLE) AS value
 FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
V_SQL = """v AS (SELECT event_id, user_id AS subject,
 (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 AS age, event_type AS feature_id, value,
 CASE WHEN user_id % 2 = 0 THEN 'DM:case' ELSE 'DM:control' END AS "group", 10.0::DOUBLE AS endpoint FROM events)"""
