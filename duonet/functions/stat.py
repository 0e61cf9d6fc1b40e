"""Statistics as plain column expressions, so that they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Panels (a multiple of four) of Boole's rule for the Student integral, and how far it reaches in units of 1 / sqrt(degrees of freedom).
PANELS, REACH = 400, 12.0


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided Student p-value, null where t or dof is null: a ratio of integrals of cos(x) ** (dof - 1), each by Boole's rule (relative error about 1e-10)."""

    def reach(low: Column) -> Column:
        return F.least(F.lit(3.141592653589793 / 2), low + F.lit(REACH) / F.sqrt(dof))

    def integral(low: Column) -> Column:
        high = reach(low)
        weight = lambda k: F.when((k == 0) | (k == PANELS), 7.0).when(k % 2 == 1, 32.0).when(k % 4 == 2, 12.0).otherwise(14.0)
        value = lambda k: F.pow(F.greatest(F.cos(low + (high - low) * k / F.lit(float(PANELS))), F.lit(0.0)), dof - 1.0)
        total = F.aggregate(F.sequence(F.lit(0), F.lit(PANELS)), F.lit(0.0), lambda acc, k: acc + weight(k) * value(k))
        return total * (high - low)

    low = F.atan(F.abs(t) / F.sqrt(dof))
    return F.when(t.isNotNull() & dof.isNotNull(), F.least(F.lit(1.0), integral(low) / integral(F.lit(0.0))))


def benjamini_hochberg(df: DataFrame, p: str = "pvalue", key: str = "feature_id", out: str = "qvalue") -> DataFrame:
    """Step-up adjusted p-values (one row per tested feature or module). Null p-values are not tests: they are neither ranked
    nor counted, and their adjusted value is null.

    The ranks and running minima come from a sort that Spark range-partitions: each range ranks its own rows, the few
    numbers of each range (count, least p * m / rank) are summed up per range, and no task sees all rows.
    """
    from duonet.operators.lineage import cut

    n_ranges = max(1, min(200, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = df.repartitionByRange(n_ranges, F.col(p).asc_nulls_last(), F.col(key)).withColumn("__range", F.spark_partition_id())
    # the ranges' boundaries are sampled: fix each row's range before it is used twice
    rows = cut(rows)
    tested = F.col(p).isNotNull()
    counts = rows.groupBy("__range").agg(F.count(p).alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))  # one row a range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(p).asc_nulls_last(), key))
    ranked = rows.join(F.broadcast(offsets), "__range").withColumn("__rank", F.col("__offset") + place)
    ranked = ranked.withColumn("__raw", F.when(tested, F.col(p) * F.lit(float(total)) / F.col("__rank")))
    least = ranked.groupBy("__range").agg(F.min("__raw").alias("__least"))
    after = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    later = least.select("__range", F.min("__least").over(after).alias("__later"))
    within = Window.partitionBy("__range").orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = F.when(tested, F.least(F.min("__raw").over(within), F.coalesce("__later", F.lit(1.0)), F.lit(1.0)))
    return ranked.join(F.broadcast(later), "__range").withColumn(out, adjusted).drop("__range", "__offset", "__rank", "__raw", "__later")


def clean_name(name: Column) -> Column:
    """lower snake case; a leading digit gets an x."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain == "", "x").when(plain.rlike("^[0-9]"), F.concat(F.lit("x"), plain)).otherwise(plain)


def clean_names(df: DataFrame, name: str, out: str) -> DataFrame:
    """One cleaned name per distinct name; names that collide get _2, _3 .. in the order of the originals."""
    names = df.select(name).distinct().withColumn("__plain", clean_name(F.col(name)))
    nth = F.row_number().over(Window.partitionBy("__plain").orderBy(name))
    named = names.select(name, F.when(nth == 1, F.col("__plain")).otherwise(F.concat("__plain", F.lit("_"), nth.cast("string"))).alias(out))
    return df.join(named, name)
