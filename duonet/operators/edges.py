"""Edge operators over sparse networks: (group, feature_a, feature_b, w) with feature_a < feature_b."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duonet.functions.stat import ratio


def undirected(df: DataFrame, a: str = "feature_a", b: str = "feature_b") -> DataFrame:
    """Endpoints in order, loops dropped."""
    low, high = F.least(a, b), F.greatest(a, b)
    return df.withColumns({a: low, b: high}).where(F.col(a) < F.col(b))


def threshold(edges: DataFrame, cut: float) -> DataFrame:
    """Keeps |w| >= cut (and drops zeros)."""
    return edges.where((F.abs("w") >= cut) & (F.col("w") != 0))


def top_percent(edges: DataFrame, share: float) -> DataFrame:
    """Keeps each group's strongest share; the cut-off is the exact quantile of |w| over both triangles of the matrix."""
    cut = edges.where("w <> 0").groupBy("group").agg(F.percentile(F.abs("w"), F.lit(1.0 - share), F.lit(2)).alias("__cut"))
    return edges.where("w <> 0").join(cut, "group").where(F.abs("w") >= F.col("__cut")).drop("__cut")


def union_classified(edges: DataFrame, reference: str, other: str) -> DataFrame:
    """The full outer union of the two groups' edges with a class: a group's name, or Both. One aggregation, no join."""
    of = lambda g: F.coalesce(F.max(F.when(F.col("group") == g, F.col("w"))), F.lit(0.0))
    both = edges.groupBy("feature_a", "feature_b").agg(of(reference).alias("pcor_0"), of(other).alias("pcor_1"))
    kind = F.when((F.col("pcor_0") != 0) & (F.col("pcor_1") != 0), "Both").when(F.col("pcor_0") != 0, reference).when(F.col("pcor_1") != 0, other)
    return both.withColumn("edge", kind).where("edge is not null")


def class_counts(union: DataFrame) -> DataFrame:
    return union.groupBy("edge").agg(F.count("*").alias("n_edges"))


def styles(union: DataFrame, reference: str, other: str) -> DataFrame:
    """Line colour and type: green/2 reference only, red/3 other only, black/1 both."""
    colour = F.when(F.col("edge") == reference, "green").when(F.col("edge") == other, "red").otherwise("black")
    line = F.when(F.col("edge") == reference, 2).when(F.col("edge") == other, 3).otherwise(1)
    return union.withColumns({"color": colour, "lty": line.cast("long")})


def node_styles(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("color", F.when(F.col("de_status"), "purple").otherwise("white"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("feature_a", "feature_b")).alias("feature_id")).distinct()


def subgraph_nodes(union: DataFrame, subtype: str) -> DataFrame:
    """Nodes of a drawing: All, Both, or a group's name (its own edges and the shared ones)."""
    if subtype == "All":
        return endpoints(union)
    return endpoints(union.where(F.col("edge").isin(subtype, "Both")))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both endpoints among the nodes."""
    n = nodes.select("feature_id").distinct()
    return edges.join(n, edges["feature_a"] == n["feature_id"], "left_semi").join(n, F.col("feature_b") == n["feature_id"], "left_semi")


def consensus(partitions: DataFrame) -> DataFrame:
    """partitions: (algorithm, node, cluster). Share of algorithms that put two nodes together, for pairs that any does."""
    n = partitions.select("algorithm").distinct().count()
    a = partitions.select("algorithm", "cluster", F.col("node").alias("node_a"))
    b = partitions.select("algorithm", "cluster", F.col("node").alias("node_b"))
    pairs = a.join(b, ["algorithm", "cluster"]).where("node_a < node_b")
    return pairs.groupBy("node_a", "node_b").agg((F.count("*") / F.lit(float(n))).alias("share"))


def module_summary(members: DataFrame, nodes: DataFrame, union: DataFrame) -> DataFrame:
    """Per module: nodes, edges inside, differential nodes, condition-specific edges inside."""
    m = members.select("module", "feature_id")
    counts = m.join(nodes.select("feature_id", "de_status"), "feature_id", "left").groupBy("module").agg(F.count("*").alias("number_of_nodes"), F.coalesce(F.sum(F.col("de_status").cast("long")), F.lit(0)).alias("number_of_de_nodes"))
    a, b = m.select(F.col("module"), F.col("feature_id").alias("feature_a")), m.select(F.col("module").alias("module_b"), F.col("feature_id").alias("feature_b"))
    inside = union.join(a, "feature_a").join(b, "feature_b").where("module = module_b")
    edges = inside.groupBy("module").agg(F.count("*").alias("e"), F.sum((F.col("edge") != "Both").cast("long")).alias("d"))
    out = counts.join(edges, "module", "left")
    return out.select(F.col("module").alias("subnetworks"), "number_of_nodes", F.coalesce("e", F.lit(0)).alias("number_of_edges"), "number_of_de_nodes", F.coalesce("d", F.lit(0)).alias("number_of_de_edges"))


def large_modules(members: DataFrame, min_size: int) -> DataFrame:
    return members.groupBy("module").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)


def rerank(scored: DataFrame, score: str, module: str) -> DataFrame:
    """Modules renumbered by score; one row a module, so a single ordered window is small."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(score, module)).cast("long"))


def order_by_membership(members: DataFrame) -> DataFrame:
    """members: (node, cluster). Each node's place in the order of clusters; one row a node, at most as many as a kernel takes."""
    return members.withColumn("place", F.row_number().over(Window.orderBy("cluster", "node")).cast("long"))


def degrees(edges: DataFrame) -> DataFrame:
    """Per group and node: number of edges and sum of |w|."""
    ends = edges.select("group", "w", F.explode(F.array("feature_a", "feature_b")).alias("feature_id"))
    return ends.groupBy("group", "feature_id").agg(F.count("*").alias("degree"), F.sum(F.abs("w")).alias("strength"))


def argmin_lambda(path: DataFrame) -> DataFrame:
    """The first lambda of least finite BIC."""
    finite = F.col("bic").isNotNull() & ~F.isnan("bic") & (F.abs("bic") < float("inf"))
    return path.where(finite).agg(F.min(F.struct("bic", "lambda")).alias("b")).select("b.lambda", "b.bic")


def weight_from_probability(prob: Column) -> Column:
    return ratio(F.lit(1.0), F.lit(1e-4) + prob)


def selection_shares(chosen: DataFrame, fits: int) -> DataFrame:
    """chosen: a row for each fit, group and pair that was kept. How often each pair was, and its share of all fits."""
    n = chosen.groupBy("group", "feature_a", "feature_b").agg(F.count("*").alias("n_selected"))
    return n.withColumn("prob", F.col("n_selected") / F.lit(float(fits)))


def modules_of(partition: DataFrame) -> DataFrame:
    """(feature_id, module) of a partition (feature_id, cluster): single features are independent."""
    size = partition.groupBy("cluster").agg(F.count("*").alias("n"))
    name = F.when(F.col("n") > 1, F.concat(F.lit("subnetwork"), F.col("cluster").cast("string"))).otherwise("independent")
    return partition.join(size, "cluster").select("feature_id", name.alias("module"))
