"""Differential statistics, correlations, diagnostics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duonet.functions.stat import benjamini_hochberg, ratio, student_p

#: Up to so many features, pair sums are added up inside tasks as matrices; beyond it pairs come from a join on the sample.
MOST_DENSE = 1024


def welch(df: DataFrame, reference: str, other: str) -> DataFrame:
    """Per feature: group means, Welch t, degrees of freedom. One partial aggregation and no join."""
    of = lambda g, fn: fn(F.when(F.col("group") == g, F.col("value")))
    parts = []
    for k, g in ((1, reference), (2, other)):
        parts += [of(g, F.avg).alias(f"mean{k}"), of(g, F.var_samp).alias(f"var{k}"), of(g, F.count).cast("double").alias(f"n{k}")]
    s = df.where(F.col("group").isin(reference, other)).groupBy("feature_id").agg(*parts)
    a, b = ratio(F.col("var1"), F.col("n1")), ratio(F.col("var2"), F.col("n2"))
    s = s.withColumn("t_statistic", ratio(F.col("mean2") - F.col("mean1"), F.sqrt(a + b)))
    return s.withColumn("dof", ratio((a + b) * (a + b), ratio(a * a, F.col("n1") - 1) + ratio(b * b, F.col("n2") - 1)))


def node_list(df: DataFrame, reference: str, other: str, alpha: float = 0.05) -> DataFrame:
    """Differential expression of logged values: other minus reference.

    A feature without a statistic (constant, or too few values) has null t, p, q and directions, is not counted as a test and
    is not differential.
    """
    s = welch(df, reference, other).withColumn("pvalue", student_p(F.col("t_statistic"), F.col("dof")))
    s = benjamini_hochberg(s)
    up = lambda c: F.when(c > 0, "Up").when(c.isNotNull(), "Down")
    change = F.col("mean2") - F.col("mean1")
    return s.select(
        "feature_id",
        F.lit(f"{other} / {reference}").alias("comparison"),
        change.alias("foldchange"),
        up(change).alias("fcdirection"),
        "t_statistic",
        up(F.col("t_statistic")).alias("t_statistic_direction"),
        "pvalue",
        "qvalue",
        F.coalesce(F.col("qvalue") < alpha, F.lit(False)).alias("de_status"),
    )


def pair_moments(df: DataFrame, scope: list[str], most_dense: int = MOST_DENSE) -> DataFrame:
    """scope, feature_a < feature_b, n, sa, sb, saa, sbb, sab over samples that have both values (and a = b for one feature).

    df: scope columns, sample_id, feature_id, value. With few features each task adds up the matrices of its samples and
    emits them once, so the shuffle is tasks x features squared, whatever the number of samples. With more, pairs come from
    a self join on the sample with a partial aggregation behind it.
    """
    features = [r[0] for r in df.select("feature_id").distinct().orderBy("feature_id").limit(most_dense + 1).collect()]
    if len(features) > most_dense:
        a = df.select(*scope, "sample_id", F.col("feature_id").alias("feature_a"), F.col("value").alias("a"))
        b = df.select(*scope, "sample_id", F.col("feature_id").alias("feature_b"), F.col("value").alias("b"))
        j = a.join(b, [*scope, "sample_id"]).where((F.col("feature_a") <= F.col("feature_b")) & F.col("a").isNotNull() & F.col("b").isNotNull())
        return j.groupBy(*scope, "feature_a", "feature_b").agg(F.count("*").cast("double").alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("a")).alias("saa"), F.sum(F.col("b") * F.col("b")).alias("sbb"), F.sum(F.col("a") * F.col("b")).alias("sab"))
    number = {f: k for k, f in enumerate(features)}
    p = len(features)
    vectors = df.where("value is not null").groupBy(*scope, "sample_id").agg(F.collect_list(F.struct("feature_id", "value")).alias("v"))
    key = F.to_json(F.struct(*scope)) if scope else F.lit("{}")
    rows = vectors.select(key.alias("scope"), F.col("v.feature_id").alias("f"), F.col("v.value").alias("x"))

    def partial(batches):
        total: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            scopes = np.array(batch.column(0).to_pylist(), dtype=object)
            x, there = np.zeros((len(scopes), p)), np.zeros((len(scopes), p))
            for k, (f, v) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                at = [number[name] for name in f]
                x[k, at], there[k, at] = v, 1.0
            for s in np.unique(scopes):
                own = scopes == s
                y, m = x[own], there[own]
                now = [m.T @ m, y.T @ m, (y * y).T @ m, y.T @ y]
                total[s] = now if s not in total else [a + b for a, b in zip(total[s], now, strict=True)]
        i, j = np.triu_indices(p)
        for s, (n, sums, squares, products) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(i)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(v) for v in (n[i, j], sums[i, j], sums[j, i], squares[i, j], squares[j, i], products[i, j]))], names=["scope", "i", "j", "n", "sa", "sb", "saa", "sbb", "sab"])

    sums = ["n", "sa", "sb", "saa", "sbb", "sab"]
    parts = rows.mapInArrow(partial, "scope string, i int, j int, " + ", ".join(f"{c} double" for c in sums))
    out = parts.groupBy("scope", "i", "j").agg(*(F.sum(c).alias(c) for c in sums)).where("n > 0")
    names = F.array(*(F.lit(f) for f in features)) if features else F.array(F.lit(""))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in scope)
    opened = out.withColumn("__s", F.from_json("scope", kinds)) if scope else out
    return opened.select(*([f"__s.{c}" for c in scope]), F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), *sums)


def _centred(a: str, b: str, ab: str):
    return F.col(ab) - F.col(a) * F.col(b) / F.col("n")


def correlations(df: DataFrame, scope: list[str], most_dense: int = MOST_DENSE) -> DataFrame:
    """Pearson r of each pair feature_a < feature_b over their complete samples; null for constant features."""
    m = pair_moments(df, scope, most_dense).where("feature_a < feature_b")
    va, vb = _centred("sa", "sa", "saa"), _centred("sb", "sb", "sbb")
    tiny = lambda v, s: F.when(v > F.lit(1e-13) * F.col(s), v)
    return m.select(*scope, "feature_a", "feature_b", (_centred("sa", "sb", "sab") / F.sqrt(tiny(va, "saa") * tiny(vb, "sbb"))).alias("r"), F.col("n").cast("long").alias("n"))


def covariances(df: DataFrame, scope: list[str]) -> DataFrame:
    m = pair_moments(df, scope)
    return m.select(*scope, "feature_a", "feature_b", ratio(_centred("sa", "sb", "sab"), F.col("n") - 1).alias("cov"))


def second_moments(df: DataFrame, scope: list[str]) -> DataFrame:
    """Mean of products, not centred."""
    return pair_moments(df, scope).select(*scope, "feature_a", "feature_b", ratio(F.col("sab"), F.col("n")).alias("moment"))


def diagnostics(df: DataFrame) -> DataFrame:
    """scope (all_data and each group), least eigenvalue and condition number of the correlation matrix."""
    both = df.select("group", "sample_id", "feature_id", "value")
    pooled = both.select(F.lit("all_data").alias("scope"), F.concat_ws("|", "group", "sample_id").alias("sample_id"), "feature_id", "value")
    each = both.select(F.col("group").alias("scope"), F.col("sample_id").cast("string").alias("sample_id"), "feature_id", "value")
    pairs = correlations(pooled.unionByName(each), ["scope"])

    def eigen(rows: pa.Table) -> pa.Table:
        names = sorted(set(rows.column("feature_a").to_pylist()) | set(rows.column("feature_b").to_pylist()))
        at = {f: k for k, f in enumerate(names)}
        m = np.eye(len(names))
        for a, b, r in zip(rows.column("feature_a").to_pylist(), rows.column("feature_b").to_pylist(), rows.column("r").to_pylist(), strict=True):
            m[at[a], at[b]] = m[at[b], at[a]] = np.nan if r is None else r
        ok = np.isfinite(m).all()
        low, cond = (float(np.linalg.eigvalsh(m)[0]), float(np.linalg.cond(m))) if ok else (None, None)
        return pa.table({"scope": [rows.column("scope")[0].as_py()], "min_eigen": pa.array([low], pa.float64()), "condition_num": pa.array([cond], pa.float64())})

    return pairs.groupBy("scope").applyInArrow(eigen, "scope string, min_eigen double, condition_num double")
