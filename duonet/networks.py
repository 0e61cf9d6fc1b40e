"""Estimation grids: one Spark task for each lambda, replicate or group, around the numpy kernels.

Tuning and the final networks need the groups' covariances only, which come from one distributed pass over the samples, so
their cost does not depend on the number of samples. Resampling needs the samples themselves: they are broadcast while they
have at most MOST_CELLS values, and refused beyond.
"""

from __future__ import annotations

import hashlib
import math
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duonet.kernels.community import DETECTORS, consensus_matrix, dense
from duonet.kernels.enrichment import module_tests
from duonet.kernels.glasso import NOISE, covariance, glasso, information, joint_fit, partial_correlations, semidefinite
from duonet.operators.lineage import cut
from duonet.operators.prep import subsample_sizes
from duonet.operators.stats import pair_moments

MOST_CELLS = 8_000_000
MOST_FEATURES = 4_000


@dataclass(frozen=True)
class Moments:
    """Per group, in order: covariance, uncentred second moment, number of samples."""

    features: list[str]
    covariance: list[np.ndarray]
    second: list[np.ndarray]
    n: list[int]


def numbered(df: DataFrame) -> tuple[list[str], DataFrame]:
    """The features in order (refused beyond MOST_FEATURES), and df with their places as feature_id: what travels is numbers."""
    features = [r[0] for r in df.select("feature_id").distinct().orderBy("feature_id").limit(MOST_FEATURES + 1).collect()]
    if len(features) > MOST_FEATURES:
        raise ValueError(f"the kernels take at most {MOST_FEATURES} features")
    places = df.sparkSession.createDataFrame([(f, k) for k, f in enumerate(features)], "feature_id string, place int")
    placed = df.join(F.broadcast(places), "feature_id").withColumn("feature_id", F.col("place")).drop("place")  # at most MOST_FEATURES rows
    return features, placed


def moments(df: DataFrame, groups: list[str]) -> Moments:
    """df: group, sample_id, feature_id, value."""
    features, placed = numbered(df.where(F.col("group").isin(groups)))
    p = len(features)
    parts = pair_moments(placed, ["group"]).select("group", "feature_a", "feature_b", "n", "sa", "sb", "sab").toArrow()  # groups x features squared, as columns of numbers
    owner = np.array(parts.column("group").to_pylist(), dtype=object)
    i, j, n, sa, sb, sab = (parts.column(c).to_numpy() for c in ("feature_a", "feature_b", "n", "sa", "sb", "sab"))
    cov, second, sizes = [], [], []
    for g in groups:
        own = owner == g
        c, s = np.full((p, p), np.nan), np.full((p, p), np.nan)
        a, b, m = i[own], j[own], n[own]
        with np.errstate(invalid="ignore", divide="ignore"):
            value = (sab[own] - sa[own] * sb[own] / m) / (m - 1)
        c[a, b] = c[b, a] = value
        s[a, b] = s[b, a] = sab[own] / m
        if len(m) and m.min() < m.max():  # some samples lack values
            c, s = (semidefinite(v) if np.isfinite(v).all() else v for v in (c, s))
        cov.append(c)
        second.append(s)
        sizes.append(int(m.max()) if len(m) else 0)
    return Moments(features, cov, second, sizes)


def asymptotic_lambda(p: int, n: int) -> float:
    return math.sqrt(math.log(p) / n)


def informed_grid(lam: float) -> list[float]:
    return [k * 0.02 * lam for k in range(int(math.floor(1 / lam / 0.02 + 1e-9)) + 1)]


def uninformed_grid() -> list[float]:
    return [k * 0.05 for k in range(21)]


def around(best: float, reach: float, step: float) -> list[float]:
    k = int(round(2 * reach / step))
    return [v for v in (best - reach + i * step for i in range(k + 1)) if v > 1e-12]


def _single_threaded() -> None:
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")


def bic_path(spark: SparkSession, m: Moments, lambdas: list[float], stage: str, eps: float = 1e-6, eta: float = 0.1) -> DataFrame:
    """stage, lambda, bic, likelihood, is_finite: one joint fit for each lambda.

    Neighbouring lambdas share a task, and each fit's solver begins where the one before ended.
    """
    shared = spark.sparkContext.broadcast((m.covariance, m.n, [float(v) for v in lambdas]))
    n_tasks = max(1, min(len(lambdas), 4 * spark.sparkContext.defaultParallelism))

    def fit(batches):
        _single_threaded()
        S, n, grid = shared.value
        last = None
        for batch in batches:
            out = {"stage": [], "lambda": [], "bic": [], "likelihood": [], "is_finite": []}
            for k in batch.column(0).to_pylist():
                try:
                    found = joint_fit(S, grid[k], eta=eta, start=last)
                    bic, like = information(S, n, found, eps, eta)
                    last = found
                except (np.linalg.LinAlgError, FloatingPointError):
                    bic = like = float("inf")
                    last = None
                ok = bool(np.isfinite(bic))
                for name, v in (("stage", stage), ("lambda", grid[k]), ("bic", bic if ok else None), ("likelihood", like if ok else None), ("is_finite", ok)):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("stage", pa.string()), ("lambda", pa.float64()), ("bic", pa.float64()), ("likelihood", pa.float64()), ("is_finite", pa.bool_())]))

    return cut(spark.range(0, len(lambdas), 1, n_tasks).mapInArrow(fit, "stage string, lambda double, bic double, likelihood double, is_finite boolean"))


def best_lambda(path: DataFrame) -> float:
    row = path.where("is_finite").agg(F.min(F.struct("bic", "lambda")).alias("b")).first()["b"]
    if row is None:
        raise ValueError("no lambda gave a finite score")
    return row["lambda"]


def tune(spark: SparkSession, m: Moments, lambdas: list[float] | None, interval: float, informed: bool, eps: float, eta: float) -> tuple[DataFrame, float]:
    if lambdas is not None:
        path = bic_path(spark, m, sorted(lambdas), "given", eps, eta)
        return path, best_lambda(path)
    if informed:
        base = asymptotic_lambda(len(m.features), max(m.n))
        coarse = bic_path(spark, m, informed_grid(base), "coarse", eps, eta)
        fine = [c * base for c in around(best_lambda(coarse) / base, 0.02, interval)]
    else:
        coarse = bic_path(spark, m, uninformed_grid(), "coarse", eps, eta)
        fine = around(best_lambda(coarse), 0.05, interval)
    refined = bic_path(spark, m, fine, "fine", eps, eta)
    return coarse.unionByName(refined), best_lambda(refined)


def tune_one_group(df: DataFrame, lambda_values: list[float] | None = None, interval: float = 1e-3, informed: bool = True, eps: float = 1e-6, eta: float = 0.1) -> tuple[DataFrame, float]:
    """Lambda by BIC for a single cohort. df: sample_id, feature_id, value. The path and the best lambda."""
    one = df.select(F.lit("all").alias("group"), F.col("sample_id").cast("string").alias("sample_id"), F.col("feature_id").cast("string").alias("feature_id"), "value")
    return tune(df.sparkSession, moments(one, ["all"]), lambda_values, interval, informed, eps, eta)


def one_group_network(df: DataFrame, optimal_lambda: float | None = None, eps: float = 1e-6, **tuning) -> DataFrame:
    """feature_a, feature_b, w: partial correlations of a single cohort; lambda is tuned where none is given."""
    one = df.select(F.lit("all").alias("group"), F.col("sample_id").cast("string").alias("sample_id"), F.col("feature_id").cast("string").alias("feature_id"), "value")
    m = moments(one, ["all"])
    lam = optimal_lambda if optimal_lambda is not None else tune_one_group(df, eps=eps, **tuning)[1]
    return final_networks(df.sparkSession, m, ["all"], [lam], None, eps).drop("group")


def dense_groups(df: DataFrame, groups: list[str]) -> tuple[list[str], list[list[str]], list[np.ndarray]]:
    """Features, sample ids and samples x features matrices in a fixed order; refuses more than MOST_CELLS values.

    A value that isn't there is NaN; every feature has at least one in each group.
    """
    rows = df.where(F.col("group").isin(groups))
    if rows.count() > MOST_CELLS:
        raise ValueError(f"resampling and enrichment take at most {MOST_CELLS} values; aggregate or sample first")
    features, placed = numbered(rows)
    table = placed.select("group", F.col("sample_id").cast("string").alias("s"), "feature_id", F.col("value").cast("double").alias("value")).toArrow()
    owner, s = (table.column(c).combine_chunks().dictionary_encode() for c in ("group", "s"))
    at, value, there = table.column("feature_id").to_numpy(), table.column("value").to_numpy(), table.column("value").is_valid().to_numpy()
    if np.isnan(value[there]).any():
        raise ValueError("values must be numbers")
    owner_of, name_of = owner.dictionary.to_pylist(), np.array(s.dictionary.to_pylist(), dtype=object)
    owner, s = owner.indices.to_numpy(), s.indices.to_numpy()
    ids, out = [], []
    for g in groups:
        own = owner == (owner_of.index(g) if g in owner_of else -1)
        kept, row = np.unique(s[own], return_inverse=True)
        order = np.argsort(name_of[kept], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        if len(kept) * len(features) > MOST_CELLS:
            raise ValueError(f"resampling and enrichment take at most {MOST_CELLS} values, missing ones included; aggregate or sample first")
        cell = rank[row] * len(features) + at[own]
        if len(np.unique(cell)) < len(cell):
            raise ValueError("a value is there twice")
        wide = np.full((len(kept), len(features)), np.nan)
        wide.flat[cell] = value[own]
        if np.isnan(wide).all(0).any():
            raise ValueError("every feature needs a value in every group")
        ids.append(name_of[kept][order].tolist())
        out.append(wide)
    return features, ids, out


def _ranked(ids: list[str], rep: int, seed: int) -> list[int]:
    """Places of the samples in the md5 order of prep.hash_rank."""
    return sorted(range(len(ids)), key=lambda k: (hashlib.md5(f"{rep}~{ids[k]}~{seed}".encode()).hexdigest(), ids[k]))


def resamples(ids: list[list[str]], rep: int, seed: int, subsample: bool) -> list[list[list[int]]]:
    """One fit's rows for each group: two halves, or one sub-sample."""
    if not subsample:
        ranks = [_ranked(own, rep, seed) for own in ids]
        return [[r[: len(r) // 2] for r in ranks], [r[len(r) // 2 :] for r in ranks]]
    small = 0 if len(ids[0]) <= len(ids[1]) else 1
    take_large, take_small, again = subsample_sizes(len(ids[small]), len(ids[1 - small]))
    rows: list[list[int]] = [[], []]
    rows[1 - small] = _ranked(ids[1 - small], rep, seed)[:take_large]
    kept = _ranked(ids[small], rep, seed)[:take_small]
    order = _ranked([ids[small][k] for k in kept], rep, seed + 1)
    rows[small] = kept + [kept[k] for k in order[:again]]
    return [rows]


def stability(spark: SparkSession, df: DataFrame, groups: list[str], lam: float, nreps: int, subsample: bool, seed: int = 0, eta: float = 0.01, partitions: int | None = None) -> DataFrame:
    """group, feature_a, feature_b, n_selected, prob: how often a pair is kept over resampled joint fits.

    A fit that fails is left out, and probabilities divide by the fits that succeeded. Where samples lack values, a pair's
    covariance is over the drawn samples that have both, as in moments.
    """
    features, ids, X = dense_groups(df, groups)
    if subsample:
        subsample_sizes(*sorted((len(ids[0]), len(ids[1]))))
    shared = spark.sparkContext.broadcast((ids, X))  # at most MOST_CELLS doubles
    reps = spark.range(nreps).repartition(partitions or min(nreps, 4 * spark.sparkContext.defaultParallelism))

    def run(batches):
        _single_threaded()
        ids, X = shared.value
        for batch in batches:
            g_, i_, j_ = [], [], []
            for rep in batch.column(0).to_pylist():
                for rows in resamples(ids, rep, seed, subsample):
                    try:
                        omega = joint_fit([covariance(x[r]) for x, r in zip(X, rows, strict=True)], lam, eta=eta)
                    except (np.linalg.LinAlgError, FloatingPointError):
                        continue
                    g_.append(-1)
                    i_.append(0)
                    j_.append(0)
                    for g, o in enumerate(omega):
                        i, j = np.nonzero(np.triu(np.abs(o) > NOISE, 1))
                        g_ += [g] * len(i)
                        i_ += i.tolist()
                        j_ += j.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in (g_, i_, j_)], names=["g", "i", "j"])

    hits = cut(reps.mapInArrow(run, "g int, i int, j int").groupBy("g", "i", "j").agg(F.count("*").alias("n_selected")))
    fits = hits.where("g = -1").agg(F.sum("n_selected")).first()[0] or 0
    if not fits:
        raise ValueError("every resampled fit failed")
    names, labels = F.array(*map(F.lit, features)), F.array(*map(F.lit, groups))
    return hits.where("g >= 0").select(F.get(labels, F.col("g")).alias("group"), F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), "n_selected", (F.col("n_selected") / F.lit(float(fits))).alias("prob"))


def final_networks(spark: SparkSession, m: Moments, groups: list[str], lambdas: list[float], probabilities: DataFrame | None, eps: float, tol: float = 1e-4) -> DataFrame:
    """group, feature_a, feature_b, w: partial correlations of each group by itself, one task each; |w| >= eps."""
    at, p = {f: k for k, f in enumerate(m.features)}, len(m.features)
    weights = [np.ones((p, p)) for _ in groups]
    if probabilities is not None:
        weights = [np.full((p, p), 1 / 1e-4) for _ in groups]
        found = probabilities.select("group", "feature_a", "feature_b", "prob").toArrow()  # at most groups x features squared, as columns
        place = {g: k for k, g in enumerate(groups)}
        g, i, j = (np.array([known.get(x, -1) for x in found.column(c).to_pylist()], np.int64) for known, c in ((place, "group"), (at, "feature_a"), (at, "feature_b")))
        prob = found.column("prob").to_numpy()
        for k in range(len(groups)):
            own = (g == k) & (i >= 0) & (j >= 0)
            weights[k][i[own], j[own]] = weights[k][j[own], i[own]] = 1 / (1e-4 + prob[own])
    shared = spark.sparkContext.broadcast((m, weights, lambdas))

    def run(batches):
        _single_threaded()
        m, weights, lambdas = shared.value
        for batch in batches:
            for g in batch.column(0).to_pylist():
                w = partial_correlations(m.second[g], lambdas[g], weights[g], tol=tol)
                i, j = np.nonzero(np.triu(np.abs(w) >= eps, 1))
                yield pa.RecordBatch.from_pydict({"group": pa.array([groups[g]] * len(i), pa.string()), "feature_a": pa.array([m.features[k] for k in i], pa.string()), "feature_b": pa.array([m.features[k] for k in j], pa.string()), "w": w[i, j]})

    return cut(spark.range(len(groups)).repartition(len(groups)).mapInArrow(run, "group string, feature_a string, feature_b string, w double"))


def violations(S: np.ndarray, lam: float) -> tuple[int, int]:
    """Pairs of one group's network, and how many of them break the optimality conditions of the graphical lasso."""
    theta = glasso(S, lam, penalize_diagonal=False)
    i, j = np.triu_indices(len(S), 1)
    gap, t = (np.linalg.inv(theta) - S)[i, j], theta[i, j]
    slack = 10 * 1e-3 * float(np.abs(S[i, j]).mean())  # ten times what the solver stops at
    broken = np.where(t != 0, np.abs(gap - lam * np.sign(t)) > slack, np.abs(gap) > lam + slack)
    return len(i), int(broken.sum())


def detect(spark: SparkSession, W: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """All detectors' partitions, a task each; one that fails is left out."""
    shared = spark.sparkContext.broadcast(W)
    tasks = spark.createDataFrame([(k,) for k in DETECTORS], "algorithm string").repartition(len(DETECTORS))

    def run(batches):
        _single_threaded()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    labels = DETECTORS[name](shared.value, seed=seed).tolist()
                except (np.linalg.LinAlgError, FloatingPointError):
                    continue
                yield pa.RecordBatch.from_pydict({"algorithm": pa.array([name], pa.string()), "labels": pa.array([labels], pa.list_(pa.int32()))})

    found = {r["algorithm"]: np.array(r["labels"]) for r in tasks.mapInArrow(run, "algorithm string, labels array<int>").collect()}
    if not found:
        raise RuntimeError("every community detector failed")
    return found


@dataclass(frozen=True)
class Consensus:
    """The agreed partition, every detector's last partition, and the matrix that they were detected on (shares of agreement)."""

    labels: np.ndarray
    partitions: dict[str, np.ndarray]
    matrix: np.ndarray
    iterations: int


def consensus(spark: SparkSession, n: int, edges: tuple[np.ndarray, np.ndarray], tau: float, max_iterations: int, seed: int) -> Consensus:
    """The consensus partition of n nodes (as many as the kernels take) over the unweighted union of edges (places of both ends)."""
    W = np.zeros((n, n))
    W[edges] = W[edges[::-1]] = 1.0
    found, last, rounds = detect(spark, W, seed), W, 0
    for _ in range(max_iterations):
        share = consensus_matrix(list(found.values()))
        if len(np.unique(share)) < 3:
            break
        np.fill_diagonal(share, 0.0)
        last, rounds = np.where(share > tau, share, 0.0), rounds + 1
        found = detect(spark, last, seed)
    return Consensus(dense(next(found[k] for k in DETECTORS if k in found)), {k: dense(v) for k, v in found.items()}, last, rounds)


def enrichment(groups: list[np.ndarray], adjacency: list[np.ndarray], modules: np.ndarray):
    return module_tests(groups, adjacency, modules)
