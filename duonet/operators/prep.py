"""Study preparation: imputation, missingness, covariate adjustment, visits, recoding, sampling plans."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duonet.functions.stat import ratio


def densify(df: DataFrame, rows: list[str], feature: str = "feature_id", value: str = "value") -> DataFrame:
    """Every row key with every feature, zero where nothing was there. The features are few and bounded by a check."""
    features = [r[0] for r in df.select(feature).distinct().orderBy(feature).limit(100_001).collect()]
    if len(features) > 100_000:
        raise ValueError("densify: too many features for a dense grid")
    grid = df.select(*rows).distinct().withColumn(feature, F.explode(F.array(*map(F.lit, features))))
    return grid.join(df, [*rows, feature], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def missingness_filter(df: DataFrame, share: float = 0.3) -> DataFrame:
    """Features with at most ceil(share * n) zeros: feature_id, n, n_zero."""
    s = df.groupBy("feature_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("value") == 0, 1).otherwise(0)).cast("long").alias("n_zero"))
    return s.where(F.col("n_zero") <= F.ceil(F.lit(share) * F.col("n")))


def zero_median_impute(df: DataFrame, by: list[str]) -> DataFrame:
    """Zeros become the median of their feature, zeros included."""
    mid = df.groupBy(by).agg(F.median("value").alias("__mid"))
    return df.join(mid, by).withColumn("value", F.when(F.col("value") == 0, F.col("__mid")).otherwise(F.col("value"))).drop("__mid")


def covariate_adjust(df: DataFrame, covariate: str, by: str = "feature_id") -> DataFrame:
    """Residuals of a one-covariate regression per feature, lifted by |least residual| + 1."""
    fit = df.groupBy(by).agg(F.regr_slope("value", covariate).alias("__b"), F.regr_intercept("value", covariate).alias("__a"))
    res = df.join(fit, by).withColumn("__res", F.col("value") - F.col("__a") - F.col("__b") * F.col(covariate))
    low = res.groupBy(by).agg(F.abs(F.min("__res")).alias("__low"))
    return res.join(low, by).withColumn("adjusted", F.col("__res") + F.col("__low") + 1.0).drop("__a", "__b", "__res", "__low")


def covariates_adjust(df: DataFrame, covariates: list[str], log_transform: bool = False, scale: bool = False, by: str = "feature_id") -> DataFrame:
    """The same for two or more covariates: partial normal equations inside tasks, one small solve per feature."""
    if len(covariates) < 2:
        raise ValueError("covariates_adjust takes two or more covariates; covariate_adjust takes one")
    k = len(covariates) + 1
    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in covariates)]
    sums = [F.sum(terms[i] * terms[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(terms[i] * F.col("value")).alias(f"y{i}") for i in range(k)]
    eq = df.groupBy(by).agg(*sums)
    kind = df.schema[by].dataType.simpleString()

    def solve(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                X = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                out.append(np.linalg.lstsq(X, np.array([r[f"y{i}"] for i in range(k)]), rcond=None)[0].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=[by, "__beta"])

    beta = eq.mapInArrow(solve, f"`{by}` {kind}, __beta array<double>")
    fitted = sum((F.get("__beta", i) * terms[i] for i in range(1, k)), F.get("__beta", 0))
    res = df.join(beta, by).withColumn("__res", F.col("value") - fitted)
    low = res.groupBy(by).agg(F.abs(F.min("__res")).alias("__low"))
    out = res.join(low, by).withColumn("adjusted", F.col("__res") + F.col("__low") + 1.0).drop("__beta", "__res", "__low")
    if log_transform:
        out = out.withColumn("adjusted", F.ln("adjusted"))
    if scale:
        stats = out.groupBy(by).agg(F.avg("adjusted").alias("__m"), F.stddev_samp("adjusted").alias("__s"))
        out = out.join(stats, by).withColumn("adjusted", ratio(F.col("adjusted") - F.col("__m"), F.col("__s"))).drop("__m", "__s")
    return out


def recode(case: Column, control: Column, case_name: str = "DM:case", control_name: str = "DM:control") -> Column:
    """Both before either; null where neither holds."""
    return F.when(case & control, "BOTH").when(case, case_name).when(control, control_name)


def first_visit(df: DataFrame, subject: str, order: list[str]) -> DataFrame:
    """The least row of each subject; a grouped minimum, so a subject with many visits is pre-aggregated."""
    rest = [c for c in df.columns if c not in (subject, *order)]
    picked = df.groupBy(subject).agg(F.min(F.struct(*order, *rest)).alias("__v"))
    return picked.select(subject, "__v.*")


def last_visit(df: DataFrame, subject: str, age: str, group: str, endpoint: str, case_name: str, order: list[str], least_span: float, case_margin: float) -> DataFrame:
    """The last row of subjects of one group with a long enough span; a case's must also not lie too far before its endpoint."""
    rest = [c for c in df.columns if c not in (subject, age, *order)]
    s = df.groupBy(subject).agg(F.max(F.struct(age, *order, *rest)).alias("__v"), (F.max(age) - F.min(age)).alias("__span"), F.min(group).alias("__lo"), F.max(group).alias("__hi"))
    s = s.where((F.col("__lo") == F.col("__hi")) & (F.col("__span") >= least_span)).select(subject, "__v.*")
    return s.where((F.col(group) != case_name) | (F.col(age) - F.col(endpoint) >= case_margin))


def hash_rank(df: DataFrame, strata: list[str], keys: list[str], seed: int, out: str = "rk") -> DataFrame:
    """A random order inside strata that depends on nothing but the keys and the seed: md5 ranks."""
    text = F.concat_ws("~", *(F.col(c).cast("string") for c in keys), F.lit(str(seed)))
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(text.cast("binary")), *keys)).cast("long"))


def stratified_sample(df: DataFrame, stratum: str, key: str, share: float, seed: int) -> DataFrame:
    n = df.groupBy(stratum).agg(F.count("*").alias("__n"))
    ranked = hash_rank(df, [stratum], [key], seed).join(n, stratum)
    return ranked.where(F.col("rk") <= F.ceil(F.lit(share) * F.col("__n"))).drop("__n")


def half_split_plan(samples: DataFrame, reps: int, seed: int) -> DataFrame:
    """rep, group, sample_id, half (1 or 2): half of each group without replacement, and the rest."""
    grid = samples.select("group", "sample_id").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("rep", F.col("rep").cast("long"))
    n = samples.groupBy("group").agg(F.count("*").alias("__n"))
    ranked = hash_rank(grid, ["rep", "group"], ["rep", "sample_id"], seed).join(n, "group")
    return ranked.select("rep", "group", "sample_id", F.when(F.col("rk") <= F.floor(F.col("__n") / 2), 1).otherwise(2).cast("long").alias("half"))


def subsample_sizes(n_small: int, n_large: int) -> tuple[int, int, int]:
    """(of the larger group, of the smaller, drawn again from those); needs 1.3 * small <= large."""
    if 1.3 * n_small > n_large:
        raise ValueError("sub-sampling needs a larger group of at least 1.3 times the smaller")
    large = math.floor(round(1.3 * n_small, 9))
    if n_large > 2 * n_small:
        small = math.floor(round(0.9 * n_small, 9))
        return large, small, math.floor(round(0.1 * n_small, 9))
    return large, n_small, 0


def subsample_plan(samples: DataFrame, reps: int, seed: int) -> DataFrame:
    """rep, group, sample_id, copy: the larger group is thinned; the smaller keeps 90 %, a tenth of its size again from those."""
    sizes = {r["group"]: r["n"] for r in samples.groupBy("group").agg(F.count("*").alias("n")).collect()}
    if len(sizes) != 2:
        raise ValueError("sub-sampling needs two groups")
    small, large = sorted(sizes, key=lambda g: (sizes[g], g))
    take_large, take_small, again = subsample_sizes(sizes[small], sizes[large])
    grid = samples.select("group", "sample_id").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("rep", F.col("rep").cast("long"))
    ranked = hash_rank(grid, ["rep", "group"], ["rep", "sample_id"], seed)
    kept = ranked.where(F.col("rk") <= F.when(F.col("group") == large, take_large).otherwise(take_small))
    twice = hash_rank(kept.where(F.col("group") == small).drop("rk"), ["rep", "group"], ["rep", "sample_id"], seed + 1).where(F.col("rk") <= again)
    return kept.select("rep", "group", "sample_id", F.lit(1).cast("long").alias("copy")).unionByName(twice.select("rep", "group", "sample_id", F.lit(2).cast("long").alias("copy")))
