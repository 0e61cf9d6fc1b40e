"""Registered queries of the relational operators, each with its SQL equivalent; and of the kernels, which SQL can't express.

All run over whole tables. Computed doubles are rounded to six places on both sides, counts are BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from duonet.functions.stat import benjamini_hochberg, clean_names, student_p
from duonet.operators import aggregate, edges, prep, stats, transform
from duonet.operators.lineage import cut
from duonet.plans import fixtures as fx
from duonet.plans import kernel_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c.name, 6).alias(c.name) if isinstance(c.dataType, DoubleType) else F.col(f"`{c.name}`") for c in df.schema.fields))


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def logged_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.log_transform(fx.matrix_m(spark, sf_dir))


#: SQL pieces. P: two-sided Student p-value of columns t and dof, by the power series of the incomplete beta function (the
#: engine integrates instead); W: Welch statistics of lm.
P_SQL = """CASE WHEN t = 0 THEN 1.0 WHEN t IS NOT NULL THEN greatest(0.0, least(1.0, 1.0 - exp(0.5 * ln(y) + dof / 2 * ln(1 - y) - ln(0.5) - lgamma(0.5) - lgamma(dof / 2) + lgamma(dof / 2 + 0.5))
 * list_sum([exp(lgamma(dof / 2 + 0.5 + k) - lgamma(dof / 2 + 0.5) - lgamma(1.5 + k) + lgamma(1.5) + k * ln(y)) FOR k IN range(0, 600)]))) END"""


def welch_sql(source: str, one: str, two: str) -> str:
    return f"""w AS (SELECT feature_id, m1, m2, (m2 - m1) / nullif(sqrt(a + b), 0) AS t, (a + b) * (a + b) / nullif(a * a / (n1 - 1) + b * b / (n2 - 1), 0) AS dof FROM (
 SELECT feature_id, avg(value) FILTER ("group" = '{one}') AS m1, avg(value) FILTER ("group" = '{two}') AS m2, count(*) FILTER ("group" = '{one}') AS n1, count(*) FILTER ("group" = '{two}') AS n2,
 var_samp(value) FILTER ("group" = '{one}') / n1 AS a, var_samp(value) FILTER ("group" = '{two}') / n2 AS b FROM {source} GROUP BY feature_id)),
{q_sql(f"SELECT *, {P_SQL} AS pv FROM (SELECT *, t * t / (dof + t * t) AS y FROM w)")}"""


def q_sql(tests: str) -> str:
    """Step-up adjusted qv of the tests' pv; null pv are no tests."""
    return f"""p AS ({tests}),
r AS (SELECT *, row_number() OVER (ORDER BY pv, feature_id) AS rk, count(*) OVER () AS n FROM p WHERE pv IS NOT NULL),
q AS (SELECT p.*, CASE WHEN qr IS NOT NULL THEN least(1.0, qr) END AS qv FROM p LEFT JOIN (SELECT feature_id, min(pv * n / rk) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qr FROM r) USING (feature_id))"""


NODES_SQL = f"""WITH {fx.LM_SQL}, {welch_sql('lm', 'F', 'O')},
nodes AS (SELECT feature_id, 'O / F' AS comparison, m2 - m1 AS foldchange, CASE WHEN m2 > m1 THEN 'Up' ELSE 'Down' END AS fcdirection, t AS t_statistic, CASE WHEN t > 0 THEN 'Up' ELSE 'Down' END AS t_statistic_direction, pv AS pvalue, qv AS qvalue, qv < 0.05 AS de_status FROM q)"""


@query(NODES_SQL + " SELECT feature_id, comparison, round(foldchange, 6) AS foldchange, fcdirection, round(t_statistic, 6) AS t_statistic, t_statistic_direction, round(pvalue, 6) AS pvalue, round(qvalue, 6) AS qvalue, de_status FROM nodes")
def de_node_list(spark, sf_dir):
    return stats.node_list(logged_m(spark, sf_dir), "F", "O")


@query(f"WITH {fx.E_SQL}, {welch_sql('e', 'a', 'b')} SELECT feature_id, 'b / a' AS comparison, round(m2 - m1, 6) AS foldchange, CASE WHEN m2 > m1 THEN 'Up' ELSE 'Down' END AS fcdirection, round(t, 6) AS t_statistic, CASE WHEN t > 0 THEN 'Up' ELSE 'Down' END AS t_statistic_direction, round(pv, 6) AS pvalue, round(qv, 6) AS qvalue, qv < 0.05 AS de_status FROM q")
def de_node_list_scaled(spark, sf_dir):
    return stats.node_list(fx.matrix_e(spark, sf_dir), "a", "b")


@query(f"WITH {fx.E_SQL}, {welch_sql('e', 'a', 'b')} SELECT feature_id, round(pv, 6) AS pvalue, round(qv, 6) AS qvalue FROM q")
def bh_adjust(spark, sf_dir):
    w = stats.welch(fx.matrix_e(spark, sf_dir), "a", "b").withColumn("pvalue", student_p(F.col("t_statistic"), F.col("dof")))
    return benjamini_hochberg(w).select("feature_id", "pvalue", "qvalue")


@query(f"WITH {fx.E_SQL}, {welch_sql('e', 'a', 'b')}, {q_sql("SELECT feature_id, CASE WHEN feature_id NOT LIKE '%5' THEN pv END AS pv FROM q").replace('p AS', 'p2 AS', 1).replace('FROM p ', 'FROM p2 ').replace('r AS', 'r2 AS', 1).replace('FROM r)', 'FROM r2)').replace('q AS', 'q2 AS', 1).replace('p.*', 'p2.*')} SELECT feature_id, round(pv, 6) AS pvalue, round(qv, 6) AS qvalue FROM q2")
def bh_adjust_with_nulls(spark, sf_dir):
    """Features without a p-value are no tests: they take no rank and do not count."""
    w = stats.welch(fx.matrix_e(spark, sf_dir), "a", "b").withColumn("pvalue", F.when(~F.col("feature_id").endswith("5"), student_p(F.col("t_statistic"), F.col("dof"))))
    return benjamini_hochberg(w).select("feature_id", "pvalue", "qvalue")


CONSTANT_SQL = """ec AS (SELECT "group", sample_id, feature_id, CASE WHEN feature_id LIKE '%7' THEN 2.5 ELSE value END AS value FROM e)"""


@query(f"WITH {fx.E_SQL}, {CONSTANT_SQL}, {welch_sql('ec', 'a', 'b')} SELECT feature_id, 'b / a' AS comparison, round(m2 - m1, 6) AS foldchange, CASE WHEN m2 > m1 THEN 'Up' ELSE 'Down' END AS fcdirection, round(t, 6) AS t_statistic, CASE WHEN t > 0 THEN 'Up' WHEN t IS NOT NULL THEN 'Down' END AS t_statistic_direction, round(pv, 6) AS pvalue, round(qv, 6) AS qvalue, coalesce(qv < 0.05, false) AS de_status FROM q")
def de_node_list_constant(spark, sf_dir):
    """Constant features have no statistic and are no tests."""
    e = fx.matrix_e(spark, sf_dir)
    return stats.node_list(e.withColumn("value", F.when(F.col("feature_id").endswith("7"), 2.5).otherwise(F.col("value"))), "a", "b")


@query(f'WITH {fx.LM_SQL} SELECT "group", sample_id, feature_id, round(value, 6) AS value FROM lm')
def log_transform(spark, sf_dir):
    return logged_m(spark, sf_dir)


@query(f'WITH {fx.M_SQL} SELECT "group", sample_id, feature_id, round(ln(floor(value) + 1), 6) AS value FROM m')
def count_pseudo_log(spark, sf_dir):
    return transform.count_log(fx.matrix_m(spark, sf_dir).withColumn("value", F.floor("value").cast("double")))


@query(f'WITH {fx.LM_SQL} SELECT "group", sample_id, feature_id, round((value - avg(value) OVER g) / nullif(stddev_samp(value) OVER g, 0), 6) AS value FROM lm WINDOW g AS (PARTITION BY "group", feature_id)')
def autoscale_by_group(spark, sf_dir):
    return transform.autoscale(logged_m(spark, sf_dir)).select("group", "sample_id", "feature_id", "value")


@query(f'WITH {fx.LM_SQL}, s AS (SELECT "group", feature_id, median(value) AS mid, min(value) AS a, max(value) AS b FROM lm GROUP BY ALL) SELECT "group", sample_id, feature_id, round((value - mid) / nullif(greatest(abs(b - mid), abs(a - mid)), 0), 6) AS value FROM lm JOIN s USING ("group", feature_id)')
def median_range_scale(spark, sf_dir):
    return transform.median_range_scale(logged_m(spark, sf_dir)).select("group", "sample_id", "feature_id", "value")


@query(f'WITH {fx.M_SQL} SELECT "group", count(DISTINCT sample_id) AS n_samples, count(DISTINCT feature_id) AS n_features, count(*) AS n_values FROM m GROUP BY ALL')
def split_by_condition_counts(spark, sf_dir):
    return transform.split_counts(fx.matrix_m(spark, sf_dir))


@query("SELECT s_suppkey, feature_id, round(value, 6) AS value FROM (SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS s_nationkey FROM supplier) UNPIVOT (value FOR feature_id IN (s_acctbal, s_nationkey))")
def wide_to_long(spark, sf_dir):
    wide = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("s_nationkey"))
    return transform.lengthen(wide, ["s_suppkey"])


@query("SELECT l_suppkey AS sample_id, " + ", ".join(f"round(sum(l_extendedprice) FILTER (l_linestatus = '{g}' AND l_returnflag = '{r}'), 6) AS {g}_{r}" for g in "FO" for r in "ANR") + " FROM lineitem GROUP BY ALL")
def long_to_wide(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.concat_ws("_", "l_linestatus", "l_returnflag").alias("feature_id")).agg(F.sum("l_extendedprice").alias("value"))
    return transform.widen(lines, [f"{g}_{r}" for g in "FO" for r in "ANR"], ["sample_id"])


TOP_PARTS = "SELECT p_brand FROM part GROUP BY p_brand HAVING avg(p_retailprice) >= (SELECT avg(p_retailprice) FROM part)"


def _top_brands(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    mean = part.agg(F.avg("p_retailprice").alias("mean"))
    by = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"))
    return by.join(F.broadcast(mean), by["price"] >= mean["mean"]).select(F.col("p_brand").alias("feature_id"))  # one row is broadcast


@query(f'WITH {fx.M_SQL} SELECT "group", sample_id, feature_id, round(value, 6) AS value FROM m WHERE feature_id IN ({TOP_PARTS})')
def feature_subset_semi(spark, sf_dir):
    return transform.subset_features(fx.matrix_m(spark, sf_dir), _top_brands(spark, sf_dir)).select("group", "sample_id", "feature_id", "value")


@query(f'WITH {fx.M_SQL} SELECT "group", sample_id, feature_id, round(value, 6) AS value FROM m WHERE feature_id NOT IN ({TOP_PARTS})')
def feature_subset_anti(spark, sf_dir):
    return transform.subset_features(fx.matrix_m(spark, sf_dir), _top_brands(spark, sf_dir), keep=False).select("group", "sample_id", "feature_id", "value")


@query(f"WITH {fx.M_SQL} SELECT \"group\", sample_id, feature_id, round(value, 6) AS value FROM m WHERE NOT regexp_matches(feature_id, '[05]$')")
def feature_drop_regex(spark, sf_dir):
    return fx.matrix_m(spark, sf_dir).where(~F.col("feature_id").rlike("[05]$"))


def _pairs_sql(source: str, scope: str, expr: str, same: str = "<", by: str = '"group"') -> str:
    on = f"x.{by} = y.{by} AND " if by else ""
    extra = "" if by else 'x."group" = y."group" AND '
    cols = f"x.{by} AS {by}, " if by else ""
    return f"SELECT {cols}x.feature_id AS feature_a, y.feature_id AS feature_b, {expr} FROM {source} x JOIN {source} y ON {on}{extra}x.sample_id = y.sample_id AND x.feature_id {same} y.feature_id GROUP BY ALL"


@query(f"WITH {fx.LM_SQL} " + _pairs_sql("lm", "", "round(corr(x.value, y.value), 6) AS r, count(*) AS n"))
def corr_pairs_by_group(spark, sf_dir):
    return stats.correlations(logged_m(spark, sf_dir), ["group"])


@query(f"WITH {fx.LM_SQL} " + _pairs_sql("lm", "", "round(corr(x.value, y.value), 6) AS r, count(*) AS n", by=""))
def corr_pairs_pooled(spark, sf_dir):
    pooled = logged_m(spark, sf_dir).withColumn("sample_id", F.concat_ws("|", "group", "sample_id"))
    return stats.correlations(pooled, [])


@query(f"WITH {fx.LM_SQL} " + _pairs_sql("lm", "", "round(corr(x.value, y.value), 6) AS r, count(*) AS n"))
def corr_pairs_by_join(spark, sf_dir):
    """The plan for more features than fit a matrix."""
    return stats.correlations(logged_m(spark, sf_dir), ["group"], most_dense=0)


@query(f"WITH {fx.LM_SQL} " + _pairs_sql("lm", "", "round(covar_samp(x.value, y.value), 6) AS cov", "<="))
def cov_pairs(spark, sf_dir):
    return stats.covariances(logged_m(spark, sf_dir), ["group"])


@query(f"WITH {fx.LM_SQL} " + _pairs_sql("lm", "", "round(sum(x.value * y.value) / count(*), 6) AS moment", "<="))
def second_moment_pairs(spark, sf_dir):
    return stats.second_moments(logged_m(spark, sf_dir), ["group"])


@query(f'WITH {fx.M_SQL}, k AS (SELECT DISTINCT p_brand AS feature_id, substr(p_brand, 1, 7) AS feature_group FROM part) SELECT "group", sample_id, feature_group, round(avg(value), 6) AS value FROM m JOIN k USING (feature_id) GROUP BY ALL')
def knowledge_collapse(spark, sf_dir):
    groups = fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature_id"), F.substring("p_brand", 1, 7).alias("feature_group")).distinct()
    return aggregate.collapse_by_group(fx.matrix_m(spark, sf_dir), groups)


#: Three clusterings of the brands, from the whole part table.
PARTS_SQL = """b AS (SELECT p_brand AS node, count(*) AS n, sum(p_size) AS size, round(sum(p_retailprice), 2) AS price FROM part GROUP BY ALL),
parts AS (SELECT 'price' AS algorithm, node, CAST((row_number() OVER (ORDER BY price, node) - 1) // 5 AS BIGINT) AS cluster FROM b UNION ALL
 SELECT 'size', node, CAST((row_number() OVER (ORDER BY size, node) - 1) // 7 AS BIGINT) FROM b UNION ALL SELECT 'count', node, CAST(n % 4 AS BIGINT) FROM b)"""


def brand_partitions(spark, sf_dir):
    from pyspark.sql import Window

    b = fx.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("node")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"), F.round(F.sum("p_retailprice"), 2).alias("price"))
    at = lambda c: F.row_number().over(Window.orderBy(c, "node")) - 1  # noqa: E731  one row a brand
    one = b.select(F.lit("price").alias("algorithm"), "node", F.floor(at("price") / 5).alias("cluster"))
    two = b.select(F.lit("size").alias("algorithm"), "node", F.floor(at("size") / 7).alias("cluster"))
    return one.unionByName(two).unionByName(b.select(F.lit("count").alias("algorithm"), "node", (F.col("n") % 4).alias("cluster")))


@query(f"WITH {PARTS_SQL}, c AS (SELECT node, string_agg(algorithm || '=' || cluster, '|' ORDER BY algorithm) AS clusters FROM parts WHERE algorithm <> 'count' GROUP BY node) SELECT node AS feature_id, count(*) OVER (PARTITION BY clusters) AS n, min(node) OVER (PARTITION BY clusters) AS first FROM c")
def collapse_pairs_intersect(spark, sf_dir):
    two = brand_partitions(spark, sf_dir).where("algorithm <> 'count'").select(F.lit("").alias("class"), F.col("algorithm").alias("group"), F.col("node").alias("feature_id"), "cluster")
    return aggregate.co_clustered(two).select("feature_id", "n", "first")


@query(f"WITH {PARTS_SQL} SELECT x.node AS node_a, y.node AS node_b, round(count(*) / 3.0::DOUBLE, 6) AS share FROM parts x JOIN parts y ON x.algorithm = y.algorithm AND x.cluster = y.cluster AND x.node < y.node GROUP BY ALL")
def consensus_matrix(spark, sf_dir):
    return edges.consensus(brand_partitions(spark, sf_dir))


@query(f"WITH {PARTS_SQL}, s AS (SELECT x.node AS node_a, y.node AS node_b, count(*) / 3.0::DOUBLE AS share FROM parts x JOIN parts y ON x.algorithm = y.algorithm AND x.cluster = y.cluster AND x.node < y.node GROUP BY ALL) SELECT node_a, node_b, round(share, 6) AS share FROM s WHERE share > 0.5")
def consensus_threshold(spark, sf_dir):
    return edges.consensus(brand_partitions(spark, sf_dir)).where("share > 0.5")


SAMPLES_SQL = 'sm AS (SELECT DISTINCT l_linestatus AS "group", l_suppkey AS sample_id FROM lineitem)'


def samples(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("group"), F.col("l_suppkey").alias("sample_id")).distinct()


@query("SELECT p_partkey, p_type FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey || '~11'), p_partkey) AS rk, count(*) OVER (PARTITION BY p_type) AS n FROM part) WHERE rk <= ceil(0.25 * n)")
def stratified_sample(spark, sf_dir):
    return prep.stratified_sample(fx.table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "p_partkey", 0.25, 11).select("p_partkey", "p_type")


@query(f'WITH {SAMPLES_SQL}, g AS (SELECT *, unnest(range(0, 3)) AS rep FROM sm) SELECT rep, "group", sample_id, CAST(CASE WHEN row_number() OVER (PARTITION BY rep, "group" ORDER BY md5(rep || \'~\' || sample_id || \'~5\'), rep, sample_id) <= floor(count(*) OVER (PARTITION BY rep, "group") / 2) THEN 1 ELSE 2 END AS BIGINT) AS half FROM g')
def half_split_plan(spark, sf_dir):
    return prep.half_split_plan(samples(spark, sf_dir), 3, 5)


SUB_SQL = """g AS (SELECT CASE WHEN label < 3 THEN 'small' ELSE 'large' END AS "group", vec_id AS sample_id, unnest(range(0, 3)) AS rep FROM embeddings),
z AS (SELECT count(*) FILTER (label < 3) AS ns, count(*) FILTER (label >= 3) AS nl FROM embeddings),
k AS (SELECT rep, "group", sample_id FROM (SELECT *, row_number() OVER (PARTITION BY rep, "group" ORDER BY md5(rep || '~' || sample_id || '~5'), rep, sample_id) AS rk FROM g) , z
 WHERE rk <= CASE WHEN "group" = 'large' THEN floor(round(1.3 * ns, 9)) WHEN nl > 2 * ns THEN floor(round(0.9 * ns, 9)) ELSE ns END),
t AS (SELECT rep, "group", sample_id FROM (SELECT *, row_number() OVER (PARTITION BY rep, "group" ORDER BY md5(rep || '~' || sample_id || '~6'), rep, sample_id) AS rk FROM k WHERE "group" = 'small'), z WHERE nl > 2 * ns AND rk <= floor(round(0.1 * ns, 9)))"""


@query(f'WITH {SUB_SQL} SELECT rep, "group", sample_id, 1::BIGINT AS copy FROM k UNION ALL SELECT rep, "group", sample_id, 2::BIGINT FROM t')
def subsample_plan(spark, sf_dir):
    own = fx.table(spark, sf_dir, "embeddings").select(F.when(F.col("label") < 3, "small").otherwise("large").alias("group"), F.col("vec_id").alias("sample_id"))
    return prep.subsample_plan(own, 3, 5)


GRID_SQL = fx.V_SQL + """, s AS (SELECT subject, feature_id, sum(value) AS value FROM v WHERE value >= 1 GROUP BY ALL),
grid AS (SELECT subject, feature_id, coalesce(value, 0.0) AS value FROM (SELECT * FROM (SELECT DISTINCT subject FROM s), (SELECT DISTINCT feature_id FROM s)) LEFT JOIN s USING (subject, feature_id))"""
HALF_SQL = fx.V_SQL + """, grid AS (SELECT subject, feature_id, CASE WHEN value < 3 THEN 0.0 ELSE value END AS value FROM v)"""


def _grid(spark, sf_dir):
    v = fx.visits(spark, sf_dir).where("value >= 1").groupBy("subject", "feature_id").agg(F.sum("value").alias("value"))
    return prep.densify(v, ["subject"])


def _halved(spark, sf_dir):
    return fx.visits(spark, sf_dir).select("subject", "feature_id", F.when(F.col("value") < 3, 0.0).otherwise(F.col("value")).alias("value"))


@query(f"WITH {HALF_SQL} SELECT feature_id, count(*) AS n, count(*) FILTER (value = 0) AS n_zero FROM grid GROUP BY ALL HAVING n_zero <= ceil(0.3 * n)")
def missingness_filter(spark, sf_dir):
    return prep.missingness_filter(_halved(spark, sf_dir))


@query(f"WITH {GRID_SQL} SELECT subject, feature_id, round(value, 6) AS value FROM grid")
def densified_grid(spark, sf_dir):
    return _grid(spark, sf_dir).select("subject", "feature_id", "value")


@query("WITH " + fx.V_SQL + ", g AS (SELECT event_id, feature_id, CASE WHEN value < 3 THEN 0.0 ELSE value END AS value FROM v), md AS (SELECT feature_id, median(value) AS mid FROM g GROUP BY ALL) SELECT event_id, feature_id, round(CASE WHEN value = 0 THEN mid ELSE value END, 6) AS value FROM g JOIN md USING (feature_id)")
def zero_median_impute(spark, sf_dir):
    v = fx.visits(spark, sf_dir).select("event_id", "feature_id", F.when(F.col("value") < 3, 0.0).otherwise(F.col("value")).alias("value"))
    return prep.zero_median_impute(v, ["feature_id"]).select("event_id", "feature_id", "value")


@query("WITH " + fx.V_SQL + ", f AS (SELECT feature_id, regr_slope(value, age) AS b, regr_intercept(value, age) AS a FROM v GROUP BY ALL), r AS (SELECT event_id, feature_id, value - a - b * age AS res FROM v JOIN f USING (feature_id)) SELECT event_id, feature_id, round(res + abs(min(res) OVER (PARTITION BY feature_id)) + 1, 6) AS adjusted FROM r")
def covariate_adjust_1(spark, sf_dir):
    return prep.covariate_adjust(fx.visits(spark, sf_dir), "age").select("event_id", "feature_id", "adjusted")


@query("SELECT user_id AS subject, CASE WHEN a AND b THEN 'BOTH' WHEN a THEN 'DM:case' WHEN b THEN 'DM:control' END AS \"group\" FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') > 13 AS a, count(*) FILTER (event_type = 'view') > 13 AS b FROM events GROUP BY ALL)")
def recode_groups(spark, sf_dir):
    n = lambda kind: F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0)) > 13
    s = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject")).agg(n("purchase").alias("a"), n("view").alias("b"))
    return s.select("subject", prep.recode(F.col("a"), F.col("b")).alias("group"))


@query("WITH " + fx.V_SQL + ' SELECT subject, round(age, 6) AS age, event_id, feature_id, round(value, 6) AS value, "group" FROM v QUALIFY row_number() OVER (PARTITION BY subject ORDER BY age, event_id) = 1')
def first_visit(spark, sf_dir):
    return prep.first_visit(fx.visits(spark, sf_dir).drop("endpoint"), "subject", ["age", "event_id"])


@query("WITH " + fx.V_SQL + """, s AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY age DESC, event_id DESC) AS rn, max(age) OVER g - min(age) OVER g AS span, min("group") OVER g = max("group") OVER g AS one FROM v WINDOW g AS (PARTITION BY subject))
SELECT subject, round(age, 6) AS age, event_id, feature_id, round(value, 6) AS value, "group", round(endpoint, 6) AS endpoint FROM s WHERE rn = 1 AND one AND span >= 5 AND ("group" <> 'DM:case' OR age - endpoint >= -1)""")
def last_visit(spark, sf_dir):
    return prep.last_visit(fx.visits(spark, sf_dir), "subject", "age", "group", "endpoint", "DM:case", ["event_id"], 5.0, -1.0)


SHAPE_SQL = fx.M_SQL + ', z AS (SELECT count(DISTINCT feature_id) AS p, (SELECT max(n) FROM (SELECT count(DISTINCT sample_id) AS n FROM m GROUP BY "group")) AS n FROM m), ls AS (SELECT sqrt(ln(p) / n) AS lam FROM z)'


def _asymptotic(spark, sf_dir):
    m = fx.matrix_m(spark, sf_dir)
    by = m.groupBy("group").agg(F.countDistinct("sample_id").alias("n"))
    return m.agg(F.countDistinct("feature_id").alias("p")).join(F.broadcast(by.agg(F.max("n").alias("n")))).select(F.sqrt(F.ln(F.col("p").cast("double")) / F.col("n")).alias("lam"))  # two single rows


@query(f'WITH {fx.M_SQL} SELECT "group", round(sqrt(ln(p) / n), 6) AS lambda FROM (SELECT "group", count(DISTINCT sample_id) AS n FROM m GROUP BY ALL), (SELECT count(DISTINCT feature_id) AS p FROM m)')
def asymptotic_lambda(spark, sf_dir):
    m = fx.matrix_m(spark, sf_dir)
    return m.groupBy("group").agg(F.countDistinct("sample_id").alias("n")).join(F.broadcast(m.agg(F.countDistinct("feature_id").alias("p")))).select("group", F.sqrt(F.ln(F.col("p").cast("double")) / F.col("n")).alias("lambda"))


@query(f"WITH {SHAPE_SQL} SELECT round(k * 0.02::DOUBLE, 6) AS c, round(k * 0.02::DOUBLE * lam, 6) AS lambda FROM (SELECT lam, unnest(range(0, CAST(floor(1 / lam / 0.02 + 1e-9) AS BIGINT) + 1)) AS k FROM ls)")
def lambda_grid_informed(spark, sf_dir):
    s = _asymptotic(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.lit(1.0) / F.col("lam") / 0.02 + 1e-9)))
    return s.select("lam", k.alias("k")).select((F.col("k") * F.lit(0.02)).alias("c"), (F.col("k") * F.lit(0.02) * F.col("lam")).alias("lambda"))


@query("SELECT round(k * 0.05::DOUBLE, 6) AS lambda FROM (SELECT unnest(range(0, 21)) AS k)")
def lambda_grid_uninformed(spark, sf_dir):
    return spark.range(21).select((F.col("id") * F.lit(0.05)).alias("lambda"))


ED_SQL = fx.LM_SQL + ", c AS (" + _pairs_sql("lm", "", "round(corr(x.value, y.value), 6) AS w") + "), ed AS (SELECT * FROM c WHERE abs(w) >= 0.1)"
UNION_SQL = ED_SQL + """, u AS (SELECT feature_a, feature_b, coalesce(f.w, 0.0) AS pcor_0, coalesce(o.w, 0.0) AS pcor_1, CASE WHEN coalesce(f.w, 0) <> 0 AND coalesce(o.w, 0) <> 0 THEN 'Both' WHEN coalesce(f.w, 0) <> 0 THEN 'F' WHEN coalesce(o.w, 0) <> 0 THEN 'O' END AS edge
 FROM (SELECT * FROM ed WHERE "group" = 'F') f FULL JOIN (SELECT * FROM ed WHERE "group" = 'O') o USING (feature_a, feature_b))"""


def correlation_edges(spark, sf_dir):
    r = stats.correlations(logged_m(spark, sf_dir), ["group"]).select("group", "feature_a", "feature_b", F.round("r", 6).alias("w"))
    return edges.threshold(r, 0.1)


def _union(spark, sf_dir):
    return edges.union_classified(correlation_edges(spark, sf_dir), "F", "O")


@query(f'WITH {ED_SQL} SELECT "group", feature_a, feature_b, w FROM ed')
def edge_threshold(spark, sf_dir):
    return correlation_edges(spark, sf_dir)


@query(f'WITH {ED_SQL}, d AS (SELECT "group", abs(w) AS a FROM ed UNION ALL SELECT "group", abs(w) FROM ed), k AS (SELECT "group", quantile_cont(a, 0.6) AS cut FROM d GROUP BY ALL) SELECT "group", feature_a, feature_b, w FROM ed JOIN k USING ("group") WHERE abs(w) >= cut - 1e-12')
def top_percent_edges(spark, sf_dir):
    return edges.top_percent(correlation_edges(spark, sf_dir), 0.4).select("group", "feature_a", "feature_b", "w")


@query(f"WITH {UNION_SQL} SELECT * FROM u")
def edge_union_classified(spark, sf_dir):
    return _union(spark, sf_dir)


@query(f"WITH {UNION_SQL} SELECT edge, count(*) AS n_edges FROM u GROUP BY ALL")
def edge_class_counts(spark, sf_dir):
    return edges.class_counts(_union(spark, sf_dir))


@query(f"WITH {UNION_SQL} SELECT *, CASE edge WHEN 'F' THEN 'green' WHEN 'O' THEN 'red' ELSE 'black' END AS color, CAST(CASE edge WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 1 END AS BIGINT) AS lty FROM u")
def edge_styles(spark, sf_dir):
    return edges.styles(_union(spark, sf_dir), "F", "O")


@query(NODES_SQL + " SELECT feature_id, de_status, CASE WHEN de_status THEN 'purple' ELSE 'white' END AS color FROM nodes")
def node_styles(spark, sf_dir):
    return edges.node_styles(stats.node_list(logged_m(spark, sf_dir), "F", "O").select("feature_id", "de_status"))


@query(f"WITH {UNION_SQL} SELECT DISTINCT unnest([feature_a, feature_b]) AS feature_id FROM u WHERE edge IN ('F', 'Both')")
def subgraph_nodes(spark, sf_dir):
    return edges.subgraph_nodes(_union(spark, sf_dir), "F")


@query(f"WITH {UNION_SQL} SELECT * FROM u WHERE feature_a IN ({TOP_PARTS}) AND feature_b IN ({TOP_PARTS})")
def induced_edges(spark, sf_dir):
    return edges.induced(_union(spark, sf_dir), _top_brands(spark, sf_dir))


def _members(spark, sf_dir):
    return brand_partitions(spark, sf_dir).where("algorithm = 'price'").select(F.concat(F.lit("subnetwork"), F.col("cluster").cast("string")).alias("module"), F.col("node").alias("feature_id"))


SUMMARY_SQL = NODES_SQL + UNION_SQL[len(fx.LM_SQL) :].replace(", c AS", ", c AS", 1) + ", " + PARTS_SQL + """, mem AS (SELECT 'subnetwork' || cluster AS module, node AS feature_id FROM parts WHERE algorithm = 'price'),
ins AS (SELECT x.module AS module, count(*) AS e, count(*) FILTER (edge <> 'Both') AS d FROM u JOIN mem x ON feature_a = x.feature_id JOIN mem y ON feature_b = y.feature_id AND x.module = y.module GROUP BY ALL),
summ AS (SELECT module AS subnetworks, count(*) AS number_of_nodes, coalesce(max(e), 0)::BIGINT AS number_of_edges, count(*) FILTER (de_status) AS number_of_de_nodes, coalesce(max(d), 0)::BIGINT AS number_of_de_edges FROM mem LEFT JOIN nodes USING (feature_id) LEFT JOIN ins USING (module) GROUP BY module)"""


@query(SUMMARY_SQL + " SELECT * FROM summ")
def module_summary(spark, sf_dir):
    return edges.module_summary(_members(spark, sf_dir), stats.node_list(logged_m(spark, sf_dir), "F", "O"), _union(spark, sf_dir))


@query(f"WITH {PARTS_SQL} SELECT 'subnetwork' || cluster AS module, count(*) AS n FROM parts WHERE algorithm = 'size' GROUP BY ALL HAVING count(*) >= 5")
def module_filter_min_size(spark, sf_dir):
    m = brand_partitions(spark, sf_dir).where("algorithm = 'size'").select(F.concat(F.lit("subnetwork"), F.col("cluster").cast("string")).alias("module"), F.col("node").alias("feature_id"))
    return edges.large_modules(m, 5)


@query(SUMMARY_SQL + " SELECT subnetworks, number_of_edges, row_number() OVER (ORDER BY number_of_edges, subnetworks) AS rank FROM summ")
def module_rerank(spark, sf_dir):
    s = edges.module_summary(_members(spark, sf_dir), stats.node_list(logged_m(spark, sf_dir), "F", "O"), _union(spark, sf_dir))
    return edges.rerank(s.select("subnetworks", "number_of_edges"), "number_of_edges", "subnetworks")


@query("SELECT s_suppkey AS sample_id, s_name AS original_name, n_name AS nation, r_name AS region, round(s_acctbal, 6) AS acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def sample_metadata_join(spark, sf_dir):
    s, n, r = (fx.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select(F.col("s_suppkey").alias("sample_id"), F.col("s_name").alias("original_name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("acctbal"))


@query(f"WITH {fx.M_SQL}, f AS (SELECT p_brand AS feature_id, round(avg(p_retailprice), 6) AS price, count(*) AS n_parts FROM part GROUP BY ALL) SELECT feature_id, price, n_parts, round(avg(value), 6) AS mean_value FROM m JOIN f USING (feature_id) GROUP BY ALL")
def feature_metadata_join(spark, sf_dir):
    f = fx.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature_id")).agg(F.round(F.avg("p_retailprice"), 6).alias("price"), F.count("*").alias("n_parts"))
    return fx.matrix_m(spark, sf_dir).groupBy("feature_id").agg(F.avg("value").alias("mean_value")).join(f, "feature_id").select("feature_id", "price", "n_parts", "mean_value")


@query("WITH " + fx.M_SQL + " SELECT (SELECT count(*) FROM (SELECT DISTINCT \"group\", sample_id FROM m)) AS num_samples, (SELECT count(DISTINCT feature_id) FROM m) AS num_features, (SELECT count(DISTINCT \"group\") FROM m) AS num_groups")
def summary_counts(spark, sf_dir):
    m = fx.matrix_m(spark, sf_dir)
    return m.agg(F.countDistinct("group", "sample_id").alias("num_samples"), F.countDistinct("feature_id").alias("num_features"), F.countDistinct("group").alias("num_groups"))


@query("WITH n AS (SELECT DISTINCT p_name FROM part), c AS (SELECT p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS a FROM n), d AS (SELECT p_name, CASE WHEN a = '' THEN 'x' WHEN regexp_matches(a, '^[0-9]') THEN 'x' || a ELSE a END AS a FROM c), e AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p_name) AS k FROM d) SELECT p_partkey, p_name, CASE WHEN k = 1 THEN a ELSE a || '_' || k END AS clean FROM part JOIN e USING (p_name)")
def cleaned_names(spark, sf_dir):
    return clean_names(fx.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "clean").select("p_partkey", "p_name", "clean")


@query("SELECT CAST(p_size AS DOUBLE) AS lambda, round(s, 6) AS bic FROM (SELECT p_size, round(avg(p_retailprice), 6) AS s FROM part GROUP BY ALL) ORDER BY s, p_size LIMIT 1")
def argmin_lambda(spark, sf_dir):
    """The argmin of a score over a grid; here part sizes stand for lambdas."""
    path = fx.table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("lambda")).agg(F.round(F.avg("p_retailprice"), 6).alias("bic"))
    return edges.argmin_lambda(path)


@query(f'WITH {fx.M_SQL} SELECT feature_id AS sample_id, sample_id AS feature_id, "group", round(value, 6) AS value FROM m')
def transpose(spark, sf_dir):
    return transform.transpose(fx.matrix_m(spark, sf_dir))


@query(f"WITH {PARTS_SQL}, g AS (SELECT node AS feature_id, 'group' || cluster AS feature_group FROM parts WHERE algorithm = 'price' AND cluster < 2) SELECT DISTINCT p_brand AS feature_id, coalesce(feature_group, p_brand) AS feature_group FROM g RIGHT JOIN part ON feature_id = p_brand")
def membership_right_join(spark, sf_dir):
    """Every feature with its group; those without one keep their own name."""
    groups = brand_partitions(spark, sf_dir).where("algorithm = 'price' AND cluster < 2").select(F.col("node").alias("feature_id"), F.concat(F.lit("group"), F.col("cluster").cast("string")).alias("feature_group"))
    names = fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature_id")).distinct()
    return groups.join(names, "feature_id", "right").select("feature_id", F.coalesce("feature_group", "feature_id").alias("feature_group"))


ALIGN_SQL = "l AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'), r AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0)"


@query(f"WITH {ALIGN_SQL} SELECT 'only left' AS side, id FROM l WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT 'only right', id FROM r WHERE id NOT IN (SELECT id FROM l)")
def alignment_check(spark, sf_dir):
    """Ids that only one side has: here customers with urgent orders against customers with money."""
    a = fx.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()
    b = fx.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return a.join(b, "id", "left_anti").select(F.lit("only left").alias("side"), "id").unionByName(b.join(a, "id", "left_anti").select(F.lit("only right").alias("side"), "id"))


@query(f"WITH {PARTS_SQL} SELECT node, cluster, row_number() OVER (ORDER BY cluster, node) AS place FROM parts WHERE algorithm = 'count'")
def nodes_by_membership(spark, sf_dir):
    return edges.order_by_membership(brand_partitions(spark, sf_dir).where("algorithm = 'count'").select("node", "cluster"))


@query(f"WITH {PARTS_SQL} SELECT node, min(node) OVER (PARTITION BY cluster) AS root FROM parts WHERE algorithm = 'price' QUALIFY count(*) OVER (PARTITION BY cluster) > 1")
def connected_components(spark, sf_dir):
    """Components of the graph that joins each brand with its neighbour in price order inside its cluster."""
    from pyspark.sql import Window

    from duonet.operators.components import components

    one = brand_partitions(spark, sf_dir).where("algorithm = 'price'")
    after = F.lead("node").over(Window.partitionBy("cluster").orderBy("node"))
    return components(one.select(F.col("node").alias("a"), after.alias("b")).where("b is not null"))


@query(f"""WITH {fx.V_SQL}, x AS (SELECT *, CASE WHEN "group" = 'DM:case' THEN 1.0 ELSE 0.0 END AS c FROM v),
b AS (SELECT feature_id, (covar_pop(value, age) * var_pop(c) - covar_pop(value, c) * covar_pop(age, c)) / (var_pop(age) * var_pop(c) - covar_pop(age, c) ** 2) AS b1,
 (covar_pop(value, c) * var_pop(age) - covar_pop(value, age) * covar_pop(age, c)) / (var_pop(age) * var_pop(c) - covar_pop(age, c) ** 2) AS b2, avg(value) AS my, avg(age) AS m1, avg(c) AS m2 FROM x GROUP BY feature_id),
res AS (SELECT event_id, feature_id, value - my - b1 * (age - m1) - b2 * (c - m2) AS res FROM x JOIN b USING (feature_id))
SELECT event_id, feature_id, round(res + abs(min(res) OVER (PARTITION BY feature_id)) + 1, 6) AS adjusted FROM res""")
def covariates_adjust_2(spark, sf_dir):
    v = fx.visits(spark, sf_dir).withColumn("case", (F.col("group") == "DM:case").cast("double"))
    return prep.covariates_adjust(v, ["age", "case"]).select("event_id", "feature_id", "adjusted")


@query(f"WITH {ED_SQL}, u AS (SELECT feature_a, feature_b, max(w) FILTER (\"group\" = 'F') AS weight_1, max(w) FILTER (\"group\" = 'O') AS weight_2 FROM ed GROUP BY ALL) SELECT * FROM u")
def joint_graph_weights(spark, sf_dir):
    """The union of both graphs' edges with each one's weight, null where it has none."""
    e = correlation_edges(spark, sf_dir)
    side = lambda g, name: e.where(F.col("group") == g).select("feature_a", "feature_b", F.col("w").alias(name))
    return side("F", "weight_1").join(side("O", "weight_2"), ["feature_a", "feature_b"], "full")


@query(f"WITH {ED_SQL} SELECT \"group\", feature_id, count(*) AS degree, round(sum(abs(w)), 6) AS strength FROM (SELECT \"group\", w, unnest([feature_a, feature_b]) AS feature_id FROM ed) GROUP BY ALL")
def node_degrees(spark, sf_dir):
    return edges.degrees(correlation_edges(spark, sf_dir))


@query(f"WITH {fx.V_SQL}, k AS (SELECT DISTINCT subject, CASE WHEN mx >= 220 AND mn < 0.5 THEN 'BOTH' WHEN mx >= 220 THEN 'DM:case' WHEN mn < 0.5 THEN 'DM:control' END AS label FROM (SELECT subject, max(value) AS mx, min(value) AS mn FROM v GROUP BY ALL)) SELECT subject, label FROM k WHERE label <> 'BOTH'")
def recode_exclude(spark, sf_dir):
    """Recoded subjects without those that hold both labels or none."""
    v = fx.visits(spark, sf_dir).groupBy("subject").agg(F.max("value").alias("mx"), F.min("value").alias("mn"))
    return v.select("subject", prep.recode(F.col("mx") >= 220, F.col("mn") < 0.5).alias("label")).where("label is not null and label <> 'BOTH'")


#: The two features of the queries that have a closed form: summed quantity and price of each supplier, by line status.
TWO_SQL = """t2 AS (SELECT l_linestatus AS "group", l_suppkey AS sample_id, sum(l_quantity)::DOUBLE AS q, sum(l_extendedprice * (1 - l_discount))::DOUBLE AS c FROM lineitem GROUP BY ALL)"""


def two_features(spark, sf_dir):
    s = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("group"), F.col("l_suppkey").alias("sample_id")).agg(F.sum("l_quantity").alias("quantity"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    return s.unpivot(["group", "sample_id"], ["quantity", "price"], "feature_id", "value")


@query(f"""WITH {TWO_SQL}, e2 AS (SELECT 'all_data' AS scope, q, c FROM t2 UNION ALL SELECT "group", q, c FROM t2), r AS (SELECT scope, abs(corr(q, c)) AS r FROM e2 GROUP BY ALL)
SELECT scope, round(1 - r, 6) AS min_eigen, round((1 + r) / (1 - r), 6) AS condition_num FROM r""")
def diagnostics_two_features(spark, sf_dir):
    """The eigenvalues of a 2 x 2 correlation matrix are 1 + r and 1 - r."""
    return stats.diagnostics(two_features(spark, sf_dir))


@query(f"""WITH {TWO_SQL}, r AS (SELECT "group", corr(q, c) AS r, count(*) AS n FROM t2 GROUP BY ALL), m AS (SELECT *, (n - 1.0) / n AS s, r * (n - 1.0) / n AS c, sqrt(ln(2) / n) AS lam FROM r)
SELECT "group", 'price' AS feature_a, 'quantity' AS feature_b, round(sign(c) * greatest(abs(c) - lam, 0) / s, 6) AS w FROM m WHERE abs(c) > lam""")
def network_two_features(spark, sf_dir):
    """The graphical lasso of two features in closed form: the covariance between them is soft-thresholded."""
    from duonet import networks as nw

    scaled = transform.autoscale(two_features(spark, sf_dir))
    m = nw.moments(scaled, ["F", "O"])
    return nw.final_networks(spark, m, ["F", "O"], [nw.asymptotic_lambda(2, n) for n in m.n], None, 1e-6, tol=1e-10)


@query(f"""WITH {TWO_SQL}, k AS (SELECT "group", covar_samp(q, c) AS s12, var_samp(q) AS s11, var_samp(c) AS s22, count(*) AS n FROM t2 GROUP BY ALL)
SELECT round(sum(2 + ln(s11 * s22 - s12 * s12) + ln(n) * 2 / (2 * n)), 6) AS bic FROM k""")
def bic_of_given_precision(spark, sf_dir):
    """The score of the inverse covariances themselves: trace 2, the log determinant, and one edge a group."""
    import numpy as np

    from duonet import networks as nw
    from duonet.kernels.glasso import information

    m = nw.moments(two_features(spark, sf_dir), ["F", "O"])
    bic, _ = information(m.covariance, m.n, [np.linalg.inv(s) for s in m.covariance], 1e-300)
    return spark.createDataFrame([(bic,)], "bic double")


@query(f"""WITH {fx.LM_SQL}, c AS ({_pairs_sql("lm", "", "corr(x.value, y.value) AS r")}), k AS (SELECT DISTINCT p_brand AS feature_id, (row_number() OVER (ORDER BY p_brand) - 1) // 2 AS class FROM (SELECT DISTINCT p_brand FROM part)),
j AS (SELECT feature_a, feature_b, x.class AS class FROM c JOIN k x ON feature_a = x.feature_id JOIN k y ON feature_b = y.feature_id AND x.class = y.class GROUP BY ALL HAVING min(abs(r)) >= 0.05)
SELECT k.feature_id, CASE WHEN j.class IS NULL THEN k.feature_id ELSE 'knowledge: ' || k.class || '-correlation: group1' END AS feature_group, j.class IS NOT NULL AS collapsed FROM k LEFT JOIN j USING (class)""")
def hybrid_collapse_pairs(spark, sf_dir):
    """Classes of two brands: complete linkage joins them where both groups' correlations reach the threshold."""
    from pyspark.sql import Window

    brands = fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature_id")).distinct()  # a few dozen
    place = F.row_number().over(Window.orderBy("feature_id")) - 1
    return aggregate.correlation_groups(logged_m(spark, sf_dir), 0.05, brands.select("feature_id", F.floor(place / 2).cast("string").alias("feature_group")))


@query(f"""WITH {fx.LM_SQL}, sm AS (SELECT DISTINCT "group", sample_id FROM lm), g AS (SELECT *, unnest(range(0, 4)) AS rep FROM sm),
h AS (SELECT rep, "group", sample_id, CASE WHEN row_number() OVER (PARTITION BY rep, "group" ORDER BY md5(rep || '~' || sample_id || '~3'), rep, sample_id) <= count(*) OVER (PARTITION BY rep, "group") // 2 THEN 1 ELSE 2 END AS half FROM g),
x AS (SELECT rep, half, lm.* FROM lm JOIN h USING ("group", sample_id)),
c AS (SELECT rep, half, "group", a.feature_id AS feature_a, b.feature_id AS feature_b, corr(a.value, b.value) AS r FROM x a JOIN x b USING (rep, half, "group", sample_id) WHERE a.feature_id < b.feature_id GROUP BY ALL)
SELECT "group", feature_a, feature_b, count(*) AS n_selected, round(count(*) / 8.0, 6) AS prob FROM c WHERE abs(r) >= 0.1 GROUP BY ALL""")
def selection_of_correlations(spark, sf_dir):
    """Half splits, a choice of pairs in each (here by correlation), and the share of the halves that choose a pair."""
    long = logged_m(spark, sf_dir)
    plan = prep.half_split_plan(long.select("group", "sample_id").distinct(), 4, 3)
    r = stats.correlations(long.join(plan, ["group", "sample_id"]).select("rep", "half", "group", "sample_id", "feature_id", "value"), ["rep", "half", "group"])
    return edges.selection_shares(edges.threshold(r.withColumnRenamed("r", "w"), 0.1), 8)


@query(f'WITH {fx.M_SQL}, n AS (SELECT DISTINCT feature_id FROM m), s AS (SELECT DISTINCT "group", sample_id FROM m) SELECT "group", \'s\' || sample_id AS sample_id, \'s\' || sample_id AS original_name, s_name, round(s_acctbal, 6) AS s_acctbal FROM s JOIN supplier ON sample_id = s_suppkey')
def include_sample_metadata(spark, sf_dir):
    """Supplier columns joined to the samples of an experiment, by id."""
    meta = fx.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("sample_id"), "s_name", "s_acctbal")
    return _experiment(spark, sf_dir).include_metadata(meta, "samples").meta_data("samples").select("group", "sample_id", "original_name", "s_name", "s_acctbal")


@query("SELECT lower(replace(p_brand, '#', '_')) AS feature_id, p_brand AS original_name, count(*) AS n_parts FROM part GROUP BY ALL")
def include_feature_metadata(spark, sf_dir):
    meta = fx.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n_parts")).select(F.lower(F.regexp_replace("p_brand", "#", "_")).alias("feature_id"), "n_parts")
    return _experiment(spark, sf_dir).include_metadata(meta, "features").meta_data("features").select("feature_id", "original_name", "n_parts")


@query(f'WITH {fx.M_SQL} SELECT "group", \'s\' || sample_id AS sample_id, lower(replace(feature_id, \'#\', \'_\')) AS feature_id, round(sqrt(value), 6) AS value FROM m')
def added_assay(spark, sf_dir):
    """An assay of the caller's beside those of an experiment."""
    e = _experiment(spark, sf_dir)
    return e.add_expression_data(e.expression_data("input_data").withColumn("value", F.sqrt("value")), "roots").expression_data("roots")


@query(f'WITH {fx.M_SQL}, a AS (SELECT unnest([\'input_data\', \'log_input_data\', \'log_scaled_data\']) AS assay) SELECT assay, "group", count(*) AS n_values, count(DISTINCT sample_id) AS n_samples, round(sum(CASE assay WHEN \'input_data\' THEN value WHEN \'log_input_data\' THEN ln(value) ELSE 0 END), 3) AS total FROM m, a GROUP BY ALL')
def experiment_assays(spark, sf_dir):
    """What a new experiment holds: raw, logged and scaled values of both groups."""
    t = _experiment(spark, sf_dir).assays_table.groupBy("assay", "group").agg(F.count("*").alias("n_values"), F.countDistinct("sample_id").alias("n_samples"), F.sum("value").alias("total"))
    return t.withColumn("total", F.round(F.when(F.abs("total") > 1e-6, F.col("total")).otherwise(0.0), 3))


@query(f"WITH {ED_SQL} SELECT unnest(['parquet', 'orc', 'json', 'csv']) AS fmt, \"group\", feature_a, feature_b, w FROM ed")
def sinks_read_back(spark, sf_dir):
    """An edge table written in every format and read again."""
    import uuid

    from duonet import sources
    from duonet.operators.lineage import shared_folder

    e = cut(correlation_edges(spark, sf_dir))
    folder = f"{shared_folder(spark)}/sinks-{uuid.uuid4().hex}"
    parts = []
    for fmt in ("parquet", "orc", "json", "csv"):
        e.coalesce(1).write.option("header", True).format(fmt).save(f"{folder}/{fmt}")
        parts.append(sources.read(spark, f"{folder}/{fmt}", fmt, None if fmt in ("parquet", "orc") else "`group` string, feature_a string, feature_b string, w double").select(F.lit(fmt).alias("fmt"), "group", "feature_a", "feature_b", "w"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {UNION_SQL} SELECT feature_a, feature_b, edge, round(pcor_0, 6) AS pcor_0, round(pcor_1, 6) AS pcor_1 FROM u")
def network_files_read_back(spark, sf_dir):
    """The edge list's single file, read again."""
    import uuid

    from duonet import sinks
    from duonet.operators.lineage import shared_folder

    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/study_edgelist.csv"
    sinks.write_single_csv(_union(spark, sf_dir), path)
    return spark.read.schema("feature_a string, feature_b string, pcor_0 double, pcor_1 double, edge string").option("header", True).csv(path).select("feature_a", "feature_b", "edge", "pcor_0", "pcor_1")


@query(f'WITH {fx.M_SQL}, p AS (SELECT count(DISTINCT feature_id) AS p FROM m) SELECT DISTINCT "group", p * (p - 1) // 2 AS n_pairs, 0::BIGINT AS n_violations FROM m, p')
def network_optimality(spark, sf_dir):
    """How many pairs of the estimated networks break the graphical lasso's optimality conditions: none may."""
    from duonet import networks as nw

    m = nw.moments(transform.autoscale(logged_m(spark, sf_dir)), ["F", "O"])
    rows = [(g, *nw.violations(m.second[k], nw.asymptotic_lambda(len(m.features), m.n[k]))) for k, g in enumerate(("F", "O"))]
    return spark.createDataFrame(rows, "`group` string, n_pairs long, n_violations long")


@query(f"WITH {PARTS_SQL}, t AS (SELECT node AS feature_id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY node) AS k FROM parts WHERE algorithm = 'price') SELECT feature_id, CASE WHEN n > 1 THEN 'subnetwork' || cluster ELSE 'independent' END AS module FROM t JOIN (SELECT cluster, count(*) AS n FROM t GROUP BY ALL) USING (cluster)")
def modules_of_partition(spark, sf_dir):
    """A partition as modules: single nodes are independent."""
    one = brand_partitions(spark, sf_dir).where("algorithm = 'price'").select(F.col("node").alias("feature_id"), "cluster")
    return edges.modules_of(one)


def _experiment(spark, sf_dir):
    from duonet.model import Experiment

    m = fx.matrix_m(spark, sf_dir).withColumn("sample_id", F.concat(F.lit("s"), F.col("sample_id").cast("string")))
    return Experiment.from_long(m, "sample_id", "feature_id", "value", "group", levels=("F", "O"), project_name="brands")


for _name, _fn in kernel_queries.QUERIES.items():
    QUERIES[_name] = _fn
