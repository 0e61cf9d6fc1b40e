"""The experiment: an immutable bundle of lazy tables; every step returns a new one.

Two groups, in order: the first is the reference, and every contrast is second minus first.
"""

from __future__ import annotations

import dataclasses
import datetime
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duonet import networks as nw
from duonet import sinks, sources
from duonet.functions.stat import benjamini_hochberg, clean_names
from duonet.kernels.tdist import two_sided_p
from duonet.operators import aggregate, edges, stats, transform
from duonet.operators.lineage import cut
from duonet.shipping import importable


#: Least eigenvalues up to this make a data set unstable.
UNSTABLE = 1e-5


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _differ(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two tables' keys differ, either way."""
    a, b = a.select(key), b.select(key)
    return not (a.join(b, key, "left_anti").isEmpty() and b.join(a, key, "left_anti").isEmpty())


@dataclass(frozen=True)
class Experiment:
    project_name: str
    groups: tuple[str, str]
    assays_table: DataFrame  # assay, group, sample_id, feature_id, value
    samples: DataFrame
    features: DataFrame
    nodes: DataFrame | None = None
    diagnostics_table: DataFrame | None = None
    lambda_path: DataFrame | None = None
    optimized: float | None = None
    selection: DataFrame | None = None
    weighted: DataFrame | None = None  # group, feature_a, feature_b, w
    joint_edges: DataFrame | None = None
    modules: DataFrame | None = None  # module, feature_id
    module_table: DataFrame | None = None
    enriched: DataFrame | None = None
    original: Experiment | None = None
    feature_membership: DataFrame | None = None
    consensus: nw.Consensus | None = None
    settings: dict = field(default_factory=dict)

    # construction

    @classmethod
    def from_long(cls, df: DataFrame, sample: str, feature: str, value: str, group: str, levels: tuple[str, str] | None = None, project_name: str = "experiment", scaled: bool = False) -> Experiment:
        """Raw positive values (or scaled ones). Names are cleaned; the originals stay in the metadata."""
        _check(isinstance(project_name, str), "project_name must be a string")
        importable(df.sparkSession)
        kinds = dict(df.dtypes)
        _check(kinds[value].split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal"), "values must be numeric")
        long = cut(sources.from_long(df, sample, feature, value, group))  # the input is computed once; all below reads this
        seen = long.groupBy("group").agg(F.count_if(F.col("value").isNull()).alias("nulls"), F.min("value").alias("least")).limit(4).collect()
        found = sorted(r["group"] for r in seen if r["group"] is not None)
        levels = tuple(levels) if levels else tuple(found)
        _check(len(found) == 2 and set(levels) == set(found), f"two groups are needed, found {found}")
        _check(not any(r["nulls"] for r in seen), "values must not be null")
        _check(scaled or all(r["least"] > 0 for r in seen), "raw values must be positive")
        names = long.select(F.col("feature_id").alias("original_name")).distinct()
        features = cut(clean_names(names, "original_name", "feature_id").select("feature_id", "original_name"))
        samples = long.select("group", F.col("sample_id")).distinct().withColumn("original_name", F.col("sample_id"))
        renamed = features.where("feature_id <> original_name")
        base = long
        if not renamed.isEmpty():
            base = long.withColumnRenamed("feature_id", "original_name").join(features, "original_name")
        base = base.select("assay", "group", "sample_id", "feature_id", "value")
        if scaled:
            warnings.warn("differential statistics are computed on scaled data", stacklevel=2)
            warnings.warn("scaled data can not be logged again", stacklevel=2)
            shown = base.withColumn("assay", F.lit("log_scaled_data"))
            logged, tables = shown, shown
        else:
            logged = transform.log_transform(base).withColumn("assay", F.lit("log_input_data"))
            shown = transform.autoscale(logged).withColumn("assay", F.lit("log_scaled_data"))
            order = base.columns
            tables = base.unionByName(logged.select(order)).unionByName(shown.select(order))
        checked = cut(stats.diagnostics(shown))
        weak = [r["scope"] for r in checked.collect() if r["min_eigen"] is not None and r["min_eigen"] <= UNSTABLE]  # three rows
        if weak:
            warnings.warn(f"the correlation matrix of {', '.join(sorted(weak))} is close to singular (least eigenvalue at most {UNSTABLE}); collapse correlated features first", stacklevel=2)
        return cls(project_name, levels, tables, samples, features, stats.node_list(logged, *levels), checked)

    @classmethod
    def from_wide(cls, df: DataFrame, sample: str, group: str, **options) -> Experiment:
        long = sources.from_wide(df, sample, group)
        return cls.from_long(long, "sample_id", "feature_id", "value", "group", **options)

    @classmethod
    def from_triple(cls, assays: DataFrame, col_data: DataFrame, row_data: DataFrame, group: str, assay: str = "counts", pseudo_count: float = 1.0, columns: list[str] | None = None, **options) -> Experiment:
        long, samples, features = sources.from_triple(assays, col_data, row_data, group, pseudo_count, columns)
        made = cls.from_long(long.where(F.col("assay") == assay), "sample_id", "feature_id", "value", "group", **options)
        named = made.features.join(features.withColumnRenamed("feature_id", "original_name"), "original_name", "left")
        keep = samples.select(*(c for c in samples.columns if c != group))
        return dataclasses.replace(made, features=named, samples=made.samples.join(keep, "sample_id", "left"))

    def _spark(self):
        return self.assays_table.sparkSession

    # steps

    def tune_lambda(self, lambda_values: list[float] | None = None, interval: float = 1e-3, informed: bool = True, assay: str = "log_scaled_data", eps: float = 1e-6, eta: float = 0.1) -> Experiment:
        _check(lambda_values is None or all(0 <= v <= 1 for v in lambda_values), "lambda values must lie in [0, 1]")
        _check(0 < interval <= 0.01, "interval must lie in (0, 0.01]")
        _check(isinstance(informed, bool), "informed must be a boolean")
        _check(0 < eps < 1, "eps must lie in (0, 1)")
        m = nw.moments(self.expression_data(assay), list(self.groups))
        path, best = nw.tune(self._spark(), m, lambda_values, interval, informed, eps, eta)
        return dataclasses.replace(self, lambda_path=path, optimized=best)

    def _default_lambda(self, assay: str) -> float:
        m = nw.moments(self.expression_data(assay), list(self.groups))
        return nw.asymptotic_lambda(len(m.features), max(m.n))

    def stability_selection(self, subsample: bool = False, nreps: int = 500, optimal_lambda: float | None = None, assay: str = "log_scaled_data", seed: int = 0, partitions: int | None = None) -> Experiment:
        _check(isinstance(nreps, int) and nreps > 0, "nreps must be a positive integer")
        _check(isinstance(subsample, bool), "subsample must be a boolean")
        _check(optimal_lambda is None or 0 <= optimal_lambda <= 1, "optimal_lambda must lie in [0, 1]")
        lam = optimal_lambda if optimal_lambda is not None else self.optimized
        if lam is None:
            lam = self._default_lambda(assay)
            warnings.warn(f"no lambda was tuned: sqrt(ln p / n) = {lam:.6f} is used", stacklevel=2)
        found = nw.stability(self._spark(), self.expression_data(assay), list(self.groups), lam, nreps, subsample, seed, partitions=partitions)
        return dataclasses.replace(self, selection=found, optimized=lam)

    def estimate_networks(self, lambda_values: list[float] | None = None, aprox: bool = False, informed: bool = True, interval: float = 1e-3, assay: str = "log_scaled_data", eps: float = 1e-6, eta: float = 0.1, optimal_lambdas: tuple[float, float] | None = None) -> Experiment:
        _check(optimal_lambdas is None or (len(optimal_lambdas) == 2 and all(0 <= v <= 1 for v in optimal_lambdas)), "optimal_lambdas are two values in [0, 1], by group")
        _check(lambda_values is None or all(0 <= v <= 1 for v in lambda_values), "lambda values must lie in [0, 1]")
        _check(0 < eps < 1, "eps must lie in (0, 1)")
        m = nw.moments(self.expression_data(assay), list(self.groups))
        if optimal_lambdas is not None:
            lambdas = list(optimal_lambdas)
        elif aprox:
            lambdas = [nw.asymptotic_lambda(len(m.features), n) for n in m.n]
        else:
            one = lambda k: nw.Moments(m.features, [m.covariance[k]], [m.second[k]], [m.n[k]])
            lambdas = [nw.tune(self._spark(), one(k), lambda_values, interval, informed, eps, eta)[1] for k in (0, 1)]
        w = nw.final_networks(self._spark(), m, list(self.groups), lambdas, self.selection, eps)
        return self._with_networks(w)

    def _with_networks(self, w: DataFrame) -> Experiment:
        return dataclasses.replace(self, weighted=w, joint_edges=edges.union_classified(w, *self.groups), modules=None, module_table=None, enriched=None, consensus=None)

    def filter_networks(self, pcor: float | None = None, top_percent: float | None = None) -> Experiment:
        """Exactly one filter; filters compose, because each replaces the networks."""
        _check(self.weighted is not None, "estimate the networks first")
        return self._with_networks(filter_edges(self.weighted, pcor, top_percent))

    def cluster(self, tau: float = 0.5, max_iterations: int = 5, seed: int = 0) -> Experiment:
        _check(0.5 <= tau <= 1, "tau must lie in [0.5, 1]")
        _check(self.joint_edges is not None, "estimate the networks first")
        names = [r[0] for r in self.features.select("feature_id").distinct().orderBy("feature_id").limit(nw.MOST_FEATURES + 1).collect()]
        _check(len(names) <= nw.MOST_FEATURES, f"clustering takes at most {nw.MOST_FEATURES} features")
        at = {f: k for k, f in enumerate(names)}
        ends = self.joint_edges.select("feature_a", "feature_b").toArrow()  # of those features
        pairs = tuple(np.array([at[f] for f in ends.column(c).to_pylist()], np.int64) for c in ("feature_a", "feature_b"))
        agreed = nw.consensus(self._spark(), len(names), pairs, tau, max_iterations, seed)
        labels = agreed.labels
        sizes = np.bincount(labels)
        order = {c: k + 1 for k, c in enumerate(c for c in range(len(sizes)) if sizes[c] > 1)}
        rows = [(f"subnetwork{order[c]}" if c in order else "independent", f) for f, c in zip(names, labels.tolist(), strict=True)]
        members = self._spark().createDataFrame(rows, "module string, feature_id string")
        summary = edges.module_summary(members, self.nodes, self.joint_edges)
        nodes = self.nodes.drop("membership").join(members.select("feature_id", F.regexp_replace("module", "subnetwork", "").alias("membership")), "feature_id", "left")
        return dataclasses.replace(self, modules=members, module_table=summary, nodes=nodes, enriched=None, consensus=agreed)

    def enrich(self, min_size: int = 5, assay: str | None = None, pathways: DataFrame | None = None) -> Experiment:
        """pathways: (module, feature_id) in place of the modules found."""
        _check(min_size >= 1, "min_size must be at least 1")
        _check(self.weighted is not None and (pathways is not None or self.modules is not None), "cluster first, or give pathways")
        assay = assay or ("log_input_data" if "log_input_data" in self.assays() else "log_scaled_data")
        names, _, X = nw.dense_groups(self.expression_data(assay), list(self.groups))
        at = {f: k for k, f in enumerate(names)}
        A = [np.zeros((len(names), len(names))) for _ in self.groups]
        ends = self.weighted.select("group", "feature_a", "feature_b", "w").toArrow()  # groups x features squared at most, as columns
        i, j = (np.array([at[f] for f in ends.column(c).to_pylist()], np.int64) for c in ("feature_a", "feature_b"))
        owner, w = np.array([self.groups.index(g) for g in ends.column("group").to_pylist()], np.int64), ends.column("w").to_numpy()
        for g, own in enumerate(A):
            own[i[owner == g], j[owner == g]] = own[j[owner == g], i[owner == g]] = w[owner == g]
        source = pathways if pathways is not None else self.modules.where("module <> 'independent'")
        held: dict[str, list[str]] = {}
        for r in source.join(self.features.select("feature_id").distinct(), "feature_id", "left_semi").collect():
            held.setdefault(r["module"], []).append(r["feature_id"])
        tested = sorted(m for m, f in held.items() if len(f) >= min_size)
        _check(bool(tested), f"no module has {min_size} features")
        indicator = np.zeros((len(tested), len(names)))
        for k, m in enumerate(tested):
            indicator[k, [at[f] for f in held[m]]] = 1.0
        stat, dof, mu = nw.enrichment(X, A, indicator)
        rows = [(m, float(t), float(d), two_sided_p(float(t), float(d))) for m, t, d in zip(tested, stat, dof, strict=True)]
        p = self._spark().createDataFrame(rows, "subnetworks string, statistic double, dof double, netgsa_pval double")
        scored = benjamini_hochberg(p, "netgsa_pval", "subnetworks", "netgsa_pfdr")
        members = source.where(F.col("module").isin(tested))
        table = edges.module_summary(members, self.nodes, self.joint_edges).join(scored, "subnetworks")
        ranked = edges.rerank(table, "netgsa_pfdr", "subnetworks")
        means = self._spark().createDataFrame([(f, float(a), float(b)) for f, a, b in zip(names, *mu, strict=True)], "feature_id string, mean1 double, mean2 double")
        nodes = self.nodes.drop("mean1", "mean2", "meanchange", "mc_notes").join(means, "feature_id", "left").withColumns({"meanchange": F.col("mean2") - F.col("mean1"), "mc_notes": F.lit(f"{self.groups[1]} over {self.groups[0]}")})
        out = dataclasses.replace(self, enriched=ranked, nodes=nodes)
        return out._renumbered() if pathways is None else out

    def _renumbered(self) -> Experiment:
        """Modules take the numbers of their order by adjusted p-value, everywhere; untested ones follow."""
        n = self.enriched.count()
        known = self.modules.select("module").distinct().where("module <> 'independent'")
        rest = known.join(self.enriched.select(F.col("subnetworks").alias("module")), "module", "left_anti")
        later = edges.rerank(rest, "module", "module").select("module", (F.col("rank") + n).alias("rank"))
        new = cut(self.enriched.select(F.col("subnetworks").alias("module"), "rank").unionByName(later).select("module", F.concat(F.lit("subnetwork"), F.col("rank").cast("string")).alias("new")))
        swap = lambda df, c: df.join(new.withColumnRenamed("module", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        modules = swap(self.modules, "module")
        nodes = self.nodes.drop("membership").join(modules.select("feature_id", F.regexp_replace("module", "subnetwork", "").alias("membership")), "feature_id", "left")
        return dataclasses.replace(self, modules=modules, module_table=swap(self.module_table, "subnetworks"), enriched=swap(self.enriched, "subnetworks").drop("rank"), nodes=nodes)

    def aggregate_features(self, method: str, correlation_threshold: float | None = None, feature_groups: DataFrame | None = None, assay: str = "input_data") -> Experiment:
        """Collapses features on raw intensities and starts a new experiment from the collapsed ones."""
        _check(method in ("correlation", "knowledge", "hybrid"), "method is correlation, knowledge or hybrid")
        _check(method == "correlation" or feature_groups is not None, f"{method} needs feature_groups")
        if method == "knowledge" and correlation_threshold is not None:
            warnings.warn("correlation_threshold is not used by knowledge", stacklevel=2)
        threshold = 0.9 if correlation_threshold is None else correlation_threshold
        _check(0 < threshold <= 1, "correlation_threshold must lie in (0, 1]")
        data = self.expression_data(assay)
        if method == "knowledge":
            known = feature_groups.select("feature_id", "feature_group")
            membership = self.features.select("feature_id").join(known, "feature_id", "left").withColumn("feature_group", F.coalesce("feature_group", "feature_id"))
        else:
            membership = cut(aggregate.correlation_groups(data, threshold, feature_groups if method == "hybrid" else None))
            _check(not membership.where("collapsed").isEmpty(), "no features are correlated enough in both groups")
        collapsed = aggregate.collapse_by_group(data, membership)
        made = Experiment.from_long(collapsed, "sample_id", "feature_group", "value", "group", levels=self.groups, project_name=self.project_name)
        return dataclasses.replace(made, original=self, feature_membership=membership)

    def include_metadata(self, metadata: DataFrame, type: str) -> Experiment:
        """metadata: keyed by sample_id or feature_id, the same ids as the experiment's."""
        _check(type in ("samples", "features"), "type is samples or features")
        key = "sample_id" if type == "samples" else "feature_id"
        own = self.samples if type == "samples" else self.features
        _check(key in metadata.columns and not _differ(own.distinct(), metadata, key), f"the metadata's {key} must be those of the experiment")
        extra = [c for c in metadata.columns if c == key or c not in own.columns]
        joined = own.join(metadata.select(*extra), key)
        return dataclasses.replace(self, **{type: joined})

    def add_expression_data(self, df: DataFrame, assay_name: str) -> Experiment:
        """df: group, sample_id, feature_id, value, over the same samples and features."""
        _check(not _differ(self.samples, df, "sample_id") and not _differ(self.features, df, "feature_id"), "samples and features must be those of the experiment")
        _check(set(r[0] for r in df.select("group").distinct().limit(3).collect()) == set(self.groups), "groups must be those of the experiment")
        new = df.select(F.lit(assay_name).alias("assay"), "group", F.col("sample_id").cast("string").alias("sample_id"), "feature_id", F.col("value").cast("double").alias("value"))
        return dataclasses.replace(self, assays_table=self.assays_table.where(F.col("assay") != assay_name).unionByName(new))

    def with_(self, **changes) -> Experiment:
        """A validated copy with other fields (the setters of every accessor)."""
        known = {f.name for f in dataclasses.fields(self)}
        _check(set(changes) <= known, f"unknown fields: {sorted(set(changes) - known)}")
        made = dataclasses.replace(self, **changes)
        made.validate()
        return made

    def validate(self) -> None:
        """Checks what every step relies on; raises where something is off."""
        _check(isinstance(self.project_name, str), "project_name must be a string")
        _check(len(self.groups) == 2 and self.groups[0] != self.groups[1], "two different groups are needed")
        _check({"assay", "group", "sample_id", "feature_id", "value"} <= set(self.assays_table.columns), "the assay table lacks columns")
        found = {r[0] for r in self.assays_table.select("group").distinct().limit(3).collect()}
        _check(found == set(self.groups), f"the assays' groups are {found}")
        repeated = self.assays_table.groupBy("assay", "sample_id", "feature_id", "group").count().where("count > 1")
        _check(repeated.isEmpty(), "a value is there twice")
        for table, key in ((self.samples, "sample_id"), (self.features, "feature_id")):
            _check(not _differ(self.assays_table.select(key).distinct(), table, key), f"{key} of the metadata and of the assays differ")
        if self.nodes is not None:
            _check(not _differ(self.features.select("feature_id").distinct(), self.nodes, "feature_id"), "the node list's features differ")
        if self.weighted is not None:
            ends = edges.endpoints(self.weighted)
            _check(ends.join(self.features, "feature_id", "left_anti").isEmpty(), "an edge ends at an unknown feature")
        _check(self.optimized is None or 0 <= self.optimized <= 1, "lambda must lie in [0, 1]")

    # selection and export

    def plot_selection(self, type: str = "group_networks", subtype: str = "All") -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of a drawing, with styles. type: group_networks or subnetworks (subtype: a module's number)."""
        _check(type in ("group_networks", "subnetworks"), "type is group_networks or subnetworks")
        _check(self.joint_edges is not None, "estimate the networks first")
        if type == "subnetworks":
            _check(self.modules is not None, "cluster first")
            chosen = self.modules.where(F.regexp_replace("module", "subnetwork", "") == str(subtype)).select("feature_id")
            _check(not chosen.isEmpty(), f"no module {subtype}")
        else:
            _check(subtype in ("All", "Both", *self.groups), f"subtype is All, Both or one of {self.groups}")
            chosen = self.features.select("feature_id").distinct() if subtype == "All" else edges.subgraph_nodes(self.joint_edges, subtype)
        nodes = edges.node_styles(self.nodes.join(chosen, "feature_id", "left_semi"))
        return nodes, edges.styles(edges.induced(self.joint_edges, chosen), *self.groups)

    def layout(self, type: str = "group_networks", subtype: str = "All", iterations: int = 100, seed: int = 0) -> list[tuple[str, float, float]]:
        """Force-directed coordinates of a (small) drawing."""
        nodes, drawn = self.plot_selection(type, subtype)
        names = sorted(r[0] for r in nodes.select("feature_id").limit(nw.MOST_FEATURES + 1).collect())
        _check(len(names) <= nw.MOST_FEATURES, f"a drawing has at most {nw.MOST_FEATURES} nodes")
        at = {f: k for k, f in enumerate(names)}
        links = np.array([(at[r[0]], at[r[1]]) for r in drawn.select("feature_a", "feature_b").collect()], int).reshape(-1, 2)  # of those nodes
        xy = np.random.default_rng(seed).normal(size=(len(names), 2))
        k = 1 / np.sqrt(max(len(names), 1))
        for step in range(iterations):
            delta = xy[:, None] - xy[None]
            far = np.maximum(np.linalg.norm(delta, axis=2), 1e-6)
            move = (delta * (k * k / far**2)[..., None]).sum(1)
            if len(links):
                d = xy[links[:, 0]] - xy[links[:, 1]]
                pull = d * (np.linalg.norm(d, axis=1) / k)[:, None]
                np.add.at(move, links[:, 0], -pull)
                np.add.at(move, links[:, 1], pull)
            size = np.maximum(np.linalg.norm(move, axis=1), 1e-9)
            xy = xy + move / size[:, None] * np.minimum(size, 0.1 * (1 - step / iterations))[:, None]
        return [(f, float(x), float(y)) for f, (x, y) in zip(names, xy, strict=True)]

    def to_dot(self, type: str = "group_networks", subtype: str = "All") -> str:
        """A (small) drawing in the DOT language."""
        nodes, drawn = self.plot_selection(type, subtype)
        _check(nodes.limit(nw.MOST_FEATURES + 1).count() <= nw.MOST_FEATURES, f"a drawing has at most {nw.MOST_FEATURES} nodes")
        style = {1: "solid", 2: "dashed", 3: "dotted"}
        quote = lambda x: '"' + str(x).replace('"', '\\"') + '"'
        lines = [f"  {quote(r['feature_id'])} [style=filled, fillcolor={r['color']}];" for r in nodes.orderBy("feature_id").collect()]
        lines += [f"  {quote(r['feature_a'])} -- {quote(r['feature_b'])} [color={r['color']}, style={style[r['lty']]}];" for r in drawn.orderBy("feature_a", "feature_b").collect()]
        return "graph {\n" + "\n".join(lines) + "\n}\n"

    def write_network_files(self, path: str, date: str | None = None) -> Experiment:
        """<path>/<project>_nodelist_<date>.csv and _edgelist_<date>.csv, one file each, with a header; fields are quoted where
        they need it. date: today's by default, as year-month-day."""
        _check(self.joint_edges is not None, "estimate the networks first")
        day = date or datetime.date.today().isoformat()
        for name, table in (("nodelist", self.nodes), ("edgelist", self.joint_edges)):
            sinks.write_single_csv(table, f"{path}/{self.project_name}_{name}_{day}.csv")
        return self

    # accessors

    def assays(self) -> list[str]:
        return sorted(r[0] for r in self.assays_table.select("assay").distinct().collect())

    def expression_data(self, assay: str | None = None) -> DataFrame:
        names = self.assays() if assay is None else None
        _check(assay is not None or len(names) == 1, "name an assay")
        return self.assays_table.where(F.col("assay") == (assay or names[0])).select("group", "sample_id", "feature_id", "value")

    def network_group_ids(self) -> DataFrame:
        return self.samples.select("sample_id", "group")

    def network_groups(self) -> tuple[str, str]:
        return self.groups

    def meta_data(self, type: str) -> DataFrame:
        _check(type in ("samples", "features"), "type is samples or features")
        return self.samples if type == "samples" else self.features

    def sample_names(self, original: bool = False) -> DataFrame:
        return self.samples.select(F.col("original_name" if original else "sample_id").alias("name"))

    def feature_names(self, original: bool = False) -> DataFrame:
        return self.features.select(F.col("original_name" if original else "feature_id").alias("name"))

    def num_samples(self) -> int:
        return self.samples.count()

    def num_features(self) -> int:
        return self.features.count()

    def optimized_lambda(self) -> float | None:
        return self.optimized

    def with_optimized_lambda(self, value: float) -> Experiment:
        _check(0 <= value <= 1, "lambda must lie in [0, 1]")
        return dataclasses.replace(self, optimized=value)

    def lambdas_tested(self) -> DataFrame:
        return self.lambda_path.select("stage", "lambda")

    def bic_scores(self) -> DataFrame:
        return self.lambda_path

    def selection_results(self) -> DataFrame:
        return self.selection.select("group", "feature_a", "feature_b", "n_selected")

    def selection_probabilities(self) -> DataFrame:
        return self.selection.select("group", "feature_a", "feature_b", "prob")

    def edge_list(self) -> DataFrame:
        return self.joint_edges

    def node_list(self) -> DataFrame:
        return self.nodes

    def diagnostics(self) -> DataFrame:
        return self.diagnostics_table

    def dataset_summary(self) -> DataFrame:
        s = self.samples.agg(F.count("*").alias("num_samples")).withColumn("num_features", F.lit(self.num_features()).cast("long"))
        return self.diagnostics_table.join(F.broadcast(s))  # one row

    def adjacency_matrix(self, weighted: bool = False) -> DataFrame:
        return self.weighted if weighted else self.weighted.select("group", "feature_a", "feature_b", (F.col("w") != 0).alias("connected"))

    def adjacency_graph(self, graph: str = "joint") -> DataFrame:
        """Edges with styles of the joint graph, one group's edges, or (consensus) pairs of features with their share of agreement."""
        _check(graph in ("joint", "consensus", *self.groups), f"graph is joint, consensus or one of {self.groups}")
        if graph == "consensus":
            return self.consensus_matrix()
        return edges.styles(self.joint_edges, *self.groups) if graph == "joint" else self.weighted.where(F.col("group") == graph)

    def _clustered(self) -> list[str]:
        _check(self.consensus is not None, "cluster first")
        return [r[0] for r in self.features.select("feature_id").distinct().orderBy("feature_id").collect()]  # checked by cluster()

    def consensus_clustering(self) -> DataFrame:
        """algorithm, feature_id, cluster: the last partition of every detector, and the agreed one as consensus."""
        names = self._clustered()
        found = {**self.consensus.partitions, "consensus": self.consensus.labels}
        rows = [(a, f, int(c)) for a, labels in found.items() for f, c in zip(names, labels, strict=True)]
        return self._spark().createDataFrame(rows, "algorithm string, feature_id string, cluster int")

    def consensus_matrix(self) -> DataFrame:
        """feature_a, feature_b, w: the pairs that the last round of detection was run on, with their share of agreement."""
        names = self._clustered()
        i, j = np.nonzero(np.triu(self.consensus.matrix, 1))
        rows = [(names[a], names[b], float(w)) for a, b, w in zip(i, j, self.consensus.matrix[i, j], strict=True)]
        return self._spark().createDataFrame(rows, "feature_a string, feature_b string, w double")

    def summary(self) -> DataFrame:
        return self.module_table

    def subnetwork_membership(self, wide: bool = False) -> DataFrame:
        if not wide:
            return self.modules
        names = sorted(r[0] for r in self.features.select("feature_id").distinct().limit(nw.MOST_FEATURES + 1).collect())
        _check(len(names) <= nw.MOST_FEATURES, f"the wide table has at most {nw.MOST_FEATURES} features")
        return self.modules.groupBy("module").pivot("feature_id", names).agg(F.first(F.lit(1))).na.fill(0)

    def enrichment_results(self) -> DataFrame:
        return self.enriched

    def show(self) -> str:
        lines = [f"{self.project_name}: {self.num_features()} features, {self.num_samples()} samples, groups {self.groups[0]} and {self.groups[1]}"]
        if self.optimized is not None:
            lines.append(f"optimized lambda {self.optimized:.6f}")
        if self.modules is not None:
            lines.append(f"{self.modules.where("module <> 'independent'").select('module').distinct().count()} subnetworks")
        if self.enriched is not None:
            lines.append(f"{self.enriched.where('netgsa_pfdr <= 0.05').count()} enriched")
        return "\n".join(lines)


def filter_edges(weighted: DataFrame, pcor: float | None = None, top_percent: float | None = None) -> DataFrame:
    """The same on a bare edge table (group, feature_a, feature_b, w)."""
    _check((pcor is None) != (top_percent is None), "give exactly one of pcor and top_percent")
    value = pcor if pcor is not None else top_percent
    _check(0 < value < 1, "the filter must lie in (0, 1)")
    return edges.threshold(weighted, pcor) if pcor is not None else edges.top_percent(weighted, top_percent)


def split_by_condition(df: DataFrame, labels: DataFrame, levels: tuple[str, str]) -> dict[str, DataFrame]:
    """df: sample_id, feature_id, value; labels: sample_id, group. One lazy table for each group; ids must agree."""
    _check(not _differ(df.select("sample_id").distinct(), labels, "sample_id"), "the labels' samples must be those of the data")
    joined = df.join(labels.select("sample_id", "group"), "sample_id")
    return {g: joined.where(F.col("group") == g) for g in levels}
