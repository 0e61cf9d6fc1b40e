import numpy as np
import pytest
from pyspark.sql import functions as F

from duonet import networks as nw
from duonet import sources
from duonet.functions.stat import benjamini_hochberg, student_p
from duonet.kernels.glasso import covariance
from duonet.kernels.tdist import two_sided_p
from duonet.model import Experiment, filter_edges, split_by_condition
from duonet.operators import aggregate, prep, stats, transform
from duonet.streaming import moments_to_stats, running_moments


def simulated(seed=0, n=(60, 40), p=12):
    rng = np.random.default_rng(seed)
    rows = []
    for g, k in zip(("control", "case"), n, strict=True):
        P = np.eye(p)
        P[:4, :4] -= 0.3 * (1 - np.eye(4))
        if g == "case":
            P[4:8, 4:8] -= 0.3 * (1 - np.eye(4))
        x = rng.multivariate_normal(np.zeros(p), np.linalg.inv(P), k)
        x[:, 8:] += (g == "case") * 1.0
        rows += [(g, f"{g}{i}", f"Metab {j}", float(np.exp(x[i, j]))) for i in range(k) for j in range(p)]
    return rows


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(simulated(), "grp string, smp string, feat string, val double").cache()


@pytest.fixture(scope="module")
def experiment(data):
    return Experiment.from_long(data, "smp", "feat", "val", "grp", levels=("control", "case"), project_name="study")


@pytest.fixture(scope="module")
def clustered(experiment):
    return experiment.stability_selection(nreps=4, optimal_lambda=0.1).estimate_networks(aprox=True).cluster()


def test_construction(experiment):
    assert experiment.assays() == ["input_data", "log_input_data", "log_scaled_data"]
    assert experiment.num_features() == 12 and experiment.num_samples() == 100
    names = {r["name"] for r in experiment.feature_names().collect()}
    assert "metab_3" in names and "Metab 3" in {r["name"] for r in experiment.feature_names(original=True).collect()}
    s = experiment.expression_data("log_scaled_data").groupBy("group", "feature_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in s)
    up = {r["feature_id"]: r for r in experiment.node_list().collect()}
    assert up["metab_9"]["de_status"] and up["metab_9"]["fcdirection"] == "Up" and up["metab_9"]["comparison"] == "case / control"
    assert experiment.diagnostics().count() == 3 and "12 features" in experiment.show()


def test_rejects_bad_input(spark, data, experiment):
    with pytest.raises(ValueError):
        Experiment.from_long(data, "smp", "feat", "val", "grp", project_name=3)
    with pytest.raises(ValueError):
        Experiment.from_long(data, "smp", "feat", "feat", "grp")
    with pytest.raises(ValueError):
        Experiment.from_long(data.where("grp = 'case'"), "smp", "feat", "val", "grp")
    with pytest.raises(ValueError):
        Experiment.from_long(data.withColumn("val", F.col("val") * 0), "smp", "feat", "val", "grp")
    for bad in ({"lambda_values": [0, 0.5, 1.2]}, {"lambda_values": [0, -0.2]}, {"interval": -1}, {"interval": 0.02}, {"informed": "yes"}):
        with pytest.raises(ValueError):
            experiment.tune_lambda(**bad)
    for bad in ({"nreps": -1}, {"subsample": "no"}, {"optimal_lambda": 2}):
        with pytest.raises(ValueError):
            experiment.stability_selection(**bad)
    for bad in ({"optimal_lambdas": (0.1,)}, {"optimal_lambdas": (0.1, 2)}, {"eps": 2}, {"lambda_values": [2]}):
        with pytest.raises(ValueError):
            experiment.estimate_networks(**bad)
    for step in (lambda: experiment.cluster(), lambda: experiment.cluster(tau=0.2), lambda: experiment.enrich(), lambda: experiment.enrich(min_size=0), lambda: experiment.filter_networks(pcor=0.1), lambda: experiment.plot_selection()):
        with pytest.raises(ValueError):
            step()


def test_tuning(experiment):
    tuned = experiment.tune_lambda(lambda_values=[0.05, 0.1, 0.3])
    path = {r["lambda"]: r["bic"] for r in tuned.bic_scores().collect()}
    assert tuned.optimized_lambda() == min(path, key=path.get)
    assert nw.asymptotic_lambda(134, 272) * 0.378 == pytest.approx(0.05072355, abs=1e-8)
    assert len(nw.informed_grid(nw.asymptotic_lambda(134, 272))) == 373 and len(nw.around(0.5, 0.02, 1e-3)) == 41


def test_stability(spark, experiment):
    runs = [experiment.stability_selection(nreps=4, optimal_lambda=0.1, partitions=k).selection_probabilities().collect() for k in (1, 4)]
    a, b = ({(r["group"], r["feature_a"], r["feature_b"]): r["prob"] for r in run} for run in runs)
    assert a == b and all(0 < v <= 1 for v in a.values())
    assert a.get(("control", "metab_0", "metab_1"), 0) >= 0.75
    one = experiment.stability_selection(nreps=2, optimal_lambda=0.1, subsample=True)
    assert one.selection_results().count() > 0
    assert prep.subsample_sizes(50, 272) == (65, 45, 5) and prep.subsample_sizes(50, 80) == (65, 50, 0)
    with pytest.raises(ValueError):
        prep.subsample_sizes(50, 60)


def test_networks_and_filters(experiment):
    found = experiment.estimate_networks(aprox=True)
    w = found.adjacency_matrix(weighted=True).collect()
    strong = {(r["feature_a"], r["feature_b"]) for r in w if r["group"] == "case" and abs(r["w"]) > 0.1}
    assert ("metab_4", "metab_5") in strong and ("metab_0", "metab_1") in strong
    cut = found.filter_networks(pcor=0.1)
    assert all(abs(r["w"]) >= 0.1 for r in cut.adjacency_matrix(weighted=True).collect())
    assert found.filter_networks(top_percent=0.3).edge_list().count() < found.edge_list().count()
    for bad in ({}, {"pcor": 0.1, "top_percent": 0.1}, {"pcor": 1.0}, {"top_percent": 0.0}):
        with pytest.raises(ValueError):
            filter_edges(found.adjacency_matrix(weighted=True), **bad)


def test_clustering_enrichment_export(clustered, tmp_path, experiment):
    m = {r["feature_id"]: r["module"] for r in clustered.subnetwork_membership().collect()}
    assert len(m) == 12 and m["metab_0"] == m["metab_1"] == m["metab_2"]
    assert clustered.subnetwork_membership(wide=True).count() == len(set(m.values()))
    done = clustered.enrich(min_size=2)
    res = done.enrichment_results().collect()
    assert res and all(0 <= r["netgsa_pval"] <= r["netgsa_pfdr"] <= 1 for r in res)
    by_rank = sorted(res, key=lambda r: int(r["subnetworks"][10:]))
    assert [r["netgsa_pfdr"] for r in by_rank] == sorted(r["netgsa_pfdr"] for r in res)
    assert {"mean1", "mean2", "meanchange", "mc_notes", "membership"} <= set(done.node_list().columns)
    done.write_network_files(str(tmp_path), "2024-05-06")
    spark = done.assays_table.sparkSession
    assert spark.read.option("header", True).csv(f"{tmp_path}/study_nodelist_2024-05-06.csv").count() == 12
    assert (tmp_path / "study_edgelist_2024-05-06.csv").is_file()
    found = done.consensus_clustering().groupBy("algorithm").count().collect()
    assert {r["count"] for r in found} == {12} and "consensus" in {r["algorithm"] for r in found}
    assert done.adjacency_graph("consensus").where("w <= 0").count() == 0
    nodes, links = done.plot_selection("group_networks", "case")
    assert nodes.count() <= 12 and {"color", "lty"} <= set(links.columns)
    assert len(done.layout()) == 12
    with pytest.raises(ValueError):
        done.plot_selection("subnetworks", "99")
    done.validate()
    assert done.with_(project_name="other").project_name == "other"
    with pytest.raises(ValueError):
        done.with_(optimized=3.0)
    with pytest.raises(ValueError):
        done.with_(nothing=1)
    assert done.to_dot().startswith("graph {") and "--" in done.to_dot()
    assert done.dataset_summary().count() == 3 and "enriched" in done.show()


@pytest.fixture(scope="module")
def holed(data):
    """A sample of each group lacks a value."""
    short = data.where("not (smp = 'case3' and feat = 'Metab 1') and not (smp = 'control7' and feat = 'Metab 9')")
    return Experiment.from_long(short, "smp", "feat", "val", "grp", levels=("control", "case"))


def test_enrichment_takes_incomplete_samples(clustered, holed):
    features, ids, X = nw.dense_groups(holed.expression_data("log_input_data"), list(holed.groups))
    assert [x.shape for x in X] == [(60, 12), (40, 12)] and [int(np.isnan(x).sum()) for x in X] == [1, 1]
    assert np.isnan(X[1][ids[1].index("case3"), features.index("metab_1")])
    same = clustered.enrich(min_size=2).enrichment_results().collect()
    short = holed.estimate_networks(aprox=True)
    modules = clustered.enrich(min_size=2).modules.where("module <> 'independent'")
    got = {r["subnetworks"]: r for r in short.enrich(min_size=2, pathways=modules).enrichment_results().collect()}
    assert set(got) == {r["subnetworks"] for r in same}
    assert all(0 <= r["netgsa_pval"] <= 1 for r in got.values())
    twice = holed.expression_data("log_input_data").unionByName(holed.expression_data("log_input_data").limit(1))
    gone = holed.expression_data("log_input_data").where("not (group = 'case' and feature_id = 'metab_5')")
    for bad in (twice, gone):
        with pytest.raises(ValueError):
            nw.dense_groups(bad, list(holed.groups))


def test_stability_takes_incomplete_samples(experiment, holed):
    runs = [e.stability_selection(nreps=4, optimal_lambda=0.1, partitions=k, subsample=sub).selection_probabilities().collect() for sub in (False, True) for e, k in ((experiment, 2), (holed, 1), (holed, 4))]
    whole, a, b, _, c, d = ({(r["group"], r["feature_a"], r["feature_b"]): r["prob"] for r in run} for run in runs)
    assert a == b and c == d and all(0 < v <= 1 for v in (*a.values(), *c.values()))
    assert abs(sum(a.values()) - sum(whole.values())) < 0.1 * sum(whole.values())
    assert a.get(("control", "metab_0", "metab_1"), 0) >= 0.75


def test_networks_take_incomplete_samples(spark, experiment, holed):
    def weights(e):
        found = e.tune_lambda(lambda_values=[0.05, 0.1, 0.3]).stability_selection(nreps=4).estimate_networks(lambda_values=[0.05, 0.1])
        return {(r["group"], r["feature_a"], r["feature_b"]): r["w"] for r in found.adjacency_matrix(weighted=True).collect()}

    whole, got = weights(experiment), weights(holed)
    strong = {k for k, w in whole.items() if abs(w) > 0.2}
    assert len(strong) > 5 and all(whole[k] * got.get(k, 0) > 0.02 for k in strong)
    assert max(abs(whole[k] - got.get(k, 0)) for k in whole if not {"metab_0", "metab_1", "metab_2", "metab_3", "metab_9"} & set(k)) < 0.03
    long, groups = holed.expression_data("log_scaled_data"), list(holed.groups)
    m, (_, _, X) = nw.moments(long, groups), nw.dense_groups(long, groups)
    for x, c, s in zip(X, m.covariance, m.second, strict=True):
        there = (~np.isnan(x)).astype(float)
        assert np.allclose(c, covariance(x)) and np.allclose(s, np.nan_to_num(x).T @ np.nan_to_num(x) / (there.T @ there))
    x = np.array([[1.0, 1, np.nan], [-1, -1, np.nan], [1, np.nan, 1], [-1, np.nan, -1], [np.nan, 1, -1], [np.nan, -1, 1]])  # r = 1, 1, -1
    rows = [("g", f"s{i}", f"f{j}", float(x[i, j])) for i, j in zip(*np.nonzero(~np.isnan(x)), strict=True)]
    m = nw.moments(spark.createDataFrame([*rows, ("g", "s6", "f0", 0.0)], "group string, sample_id string, feature_id string, value double"), ["g"])
    assert all(np.linalg.eigvalsh(v[0])[0] > -1e-9 and abs(v[0] - np.diag(np.diag(v[0]))).max() > 0.1 for v in (m.covariance, m.second))


def test_aggregation(spark, data, experiment):
    twin = data.unionByName(data.where("feat = 'Metab 0'").withColumn("feat", F.lit("Metab 0 twin")).withColumn("val", F.col("val") * 2))
    e = Experiment.from_long(twin, "smp", "feat", "val", "grp", levels=("control", "case"))
    got = e.aggregate_features("correlation", 0.99)
    m = {r["feature_id"]: r["feature_group"] for r in got.feature_membership.collect()}
    assert m["metab_0"] == m["metab_0_twin"] == "group1" and m["metab_1"] == "metab_1"
    assert got.num_features() == 12 and got.original is e
    groups = e.features.select("feature_id", F.when(F.col("feature_id").startswith("metab_0"), "zero").otherwise("rest").alias("feature_group"))
    assert e.aggregate_features("knowledge", feature_groups=groups).num_features() == 2
    h = e.aggregate_features("hybrid", 0.99, groups)
    assert "knowledge: zero-correlation: group1" in {r["feature_group"] for r in h.feature_membership.collect()}
    for bad in (("correlation", 0.999999, None), ("hybrid", 0.9, None), ("knowledge", None, None), ("other", None, None)):
        with pytest.raises(ValueError):
            experiment.aggregate_features(*bad)
    with pytest.warns(UserWarning):
        e.aggregate_features("knowledge", 0.9, groups)


def test_metadata_and_assays(spark, experiment):
    ages = experiment.samples.select("sample_id").withColumn("age", F.lit(3))
    assert "age" in experiment.include_metadata(ages, "samples").meta_data("samples").columns
    with pytest.raises(ValueError):
        experiment.include_metadata(ages.withColumn("sample_id", F.lit("z")), "samples")
    more = experiment.add_expression_data(experiment.expression_data("input_data"), "copy")
    assert "copy" in more.assays()
    with pytest.raises(ValueError):
        experiment.add_expression_data(experiment.expression_data("input_data").withColumn("sample_id", F.lit("z")), "copy")


def test_split_by_condition(spark):
    rows = [(f"sample{i}", f"metab{j}", float(1 + (i > 10))) for i in range(1, 21) for j in range(1, 6)]
    df = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    labels = spark.createDataFrame([(f"sample{i}", "control" if i <= 10 else "case") for i in range(1, 21)], "sample_id string, group string")
    parts = split_by_condition(df, labels, ("control", "case"))
    assert {r["value"] for r in parts["control"].collect()} == {1.0} and {r["value"] for r in parts["case"].collect()} == {2.0}
    with pytest.raises(ValueError):
        split_by_condition(df, labels.withColumn("sample_id", F.concat("sample_id", F.lit("x"))), ("control", "case"))


def test_sources(spark, tmp_path):
    wide = spark.createDataFrame([("s1", "a", 1.0, 2), ("s2", "b", 3.0, 4)], "s string, g string, f1 double, f2 int")
    assert sorted(tuple(r) for r in sources.from_wide(wide, "s", "g").collect()) == [("input_data", "a", "s1", "f1", 1.0), ("input_data", "a", "s1", "f2", 2.0), ("input_data", "b", "s2", "f1", 3.0), ("input_data", "b", "s2", "f2", 4.0)]
    counts = spark.createDataFrame([("counts", "f1", "s1", 0.0), ("tpm", "f1", "s1", 5.0)], "assay string, feature_id string, sample_id string, value double")
    col = spark.createDataFrame([("s1", "a")], "sample_id string, cond string")
    row = spark.createDataFrame([("f1", 1.5, "no")], "feature_id string, mz double, other string")
    long, _, feats = sources.from_triple(counts, col, row, "cond", columns=["mz", "rt"])
    assert {(r["assay"], r["value"]) for r in long.collect()} == {("counts", 1.0), ("tpm", 5.0)} and feats.columns == ["feature_id", "mz"]
    wide.write.option("header", True).csv(str(tmp_path / "c"))
    assert sources.read(spark, str(tmp_path / "c"), "csv").count() == 2


def test_statistics_against_numpy(spark, data):
    long = data.select(F.col("grp").alias("group"), F.col("smp").alias("sample_id"), F.col("feat").alias("feature_id"), F.ln("val").alias("value"))
    x = long.toPandas().pivot(index="sample_id", columns="feature_id", values="value")
    for most in (1024, 0):
        r = stats.correlations(long, [], most).collect()
        c = np.corrcoef(x.to_numpy().T)
        at = {f: k for k, f in enumerate(x.columns)}
        assert len(r) == 66 and all(abs(v["r"] - c[at[v["feature_a"]], at[v["feature_b"]]]) < 1e-9 for v in r)
    holes = long.withColumn("value", F.when((F.col("feature_id") == "Metab 1") & (F.col("sample_id") == "case1"), None).otherwise(F.col("value")))
    own = {(v["feature_a"], v["feature_b"]): v for v in stats.correlations(holes, []).collect()}
    assert own["Metab 0", "Metab 1"]["n"] == 99 and own["Metab 0", "Metab 2"]["n"] == 100
    constant = long.withColumn("value", F.when(F.col("feature_id") == "Metab 1", 3.7).otherwise(F.col("value")))
    assert all(v["r"] is None for v in stats.correlations(constant, []).collect() if "Metab 1" in (v["feature_a"], v["feature_b"]))
    assert transform.autoscale(constant).where("feature_id = 'Metab 1' and value is not null").isEmpty()


def test_p_values(spark):
    cases = [(t, d) for t in (0.0, 0.5, 2.5, 6.0, -3.0) for d in (2.5, 9.0, 60.0, 2000.0)]
    df = spark.createDataFrame(cases, "t double, dof double")
    for r in df.withColumn("p", student_p(F.col("t"), F.col("dof"))).collect():
        assert r["p"] == pytest.approx(two_sided_p(r["t"], r["dof"]), rel=1e-4, abs=1e-9)
    p = [0.01, 0.04, 0.03, 0.005, 0.9, 0.04]
    got = benjamini_hochberg(spark.createDataFrame([(f"f{k}", v) for k, v in enumerate(p)], "feature_id string, pvalue double"))
    order, want, low = np.argsort(p), {}, 1.0
    for rank in range(6, 0, -1):
        low = min(low, p[order[rank - 1]] * 6 / rank)
        want[f"f{order[rank - 1]}"] = low
    assert {r["feature_id"]: round(r["qvalue"], 12) for r in got.collect()} == {k: round(v, 12) for k, v in want.items()}


def test_prep(spark):
    df = spark.createDataFrame([("f", float(i), float(i % 3), 2.0 * i + (i % 3) + 5) for i in range(20)], "feature_id string, age double, sex double, value double")
    out = prep.covariates_adjust(df, ["age", "sex"]).collect()
    assert all(abs(r["adjusted"] - 1) < 1e-6 for r in out)
    with pytest.raises(ValueError):
        prep.covariates_adjust(df, ["age"])
    scaled = prep.covariates_adjust(df.withColumn("value", F.col("value") + F.col("age") * F.col("age")), ["age", "sex"], True, True)
    assert abs(scaled.agg(F.avg("adjusted")).first()[0]) < 1e-9


def test_collapse_in_both_groups(spark):
    c = spark.createDataFrame([("", "a", "x", 0), ("", "a", "y", 0), ("", "a", "z", 0), ("", "b", "x", 1), ("", "b", "y", 1), ("", "b", "z", 2)], "class string, group string, feature_id string, cluster int")
    assert {r["feature_id"]: r["n"] for r in aggregate.co_clustered(c).collect()} == {"x": 2, "y": 2, "z": 1}


def test_streaming_moments(spark, tmp_path):
    rows = [("a", "f", float(i)) for i in range(10)]
    spark.createDataFrame(rows, "group string, feature_id string, value double").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("group string, feature_id string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_moments(stream).writeStream.outputMode("complete").format("memory").queryName("moments").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    r = moments_to_stats(spark.table("moments")).first()
    assert r["mean"] == pytest.approx(4.5) and r["var"] == pytest.approx(np.var(range(10), ddof=1))


def test_connected_components(spark):
    from duonet.operators.components import components

    rng = np.random.default_rng(8)
    chain = [(i, i + 1) for i in range(60)]
    pairs = chain + [(int(a) + 100, int(b) + 100) for a, b in rng.integers(0, 80, (50, 2))] + [(5, 5), (2, 1)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
