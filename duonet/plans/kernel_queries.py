"""Queries of the numeric kernels: SQL can't express them, unit tests hold them against brute force and simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duonet.operators import aggregate, transform
from duonet.operators.stats import diagnostics as diagnose
from duonet.plans import fixtures as fx


def experiment(spark, sf_dir):
    from duonet.model import Experiment

    return Experiment.from_long(fx.matrix_m(spark, sf_dir), "sample_id", "feature_id", "value", "group", levels=("F", "O"), project_name="brands")


def diagnostics(spark, sf_dir) -> DataFrame:
    scaled = transform.autoscale(transform.log_transform(fx.matrix_m(spark, sf_dir)))
    return diagnose(scaled)


def bic_path(spark, sf_dir) -> DataFrame:
    return experiment(spark, sf_dir).tune_lambda().bic_scores()


def stability_probabilities(spark, sf_dir) -> DataFrame:
    return experiment(spark, sf_dir).tune_lambda().stability_selection().selection_probabilities()


def partial_corr_network(spark, sf_dir) -> DataFrame:
    """Each group's lambda tuned by itself; the pairs' penalties follow from how often resampled fits select them."""
    return experiment(spark, sf_dir).tune_lambda().stability_selection().estimate_networks().adjacency_matrix(weighted=True)


def one_group_path(spark, sf_dir) -> DataFrame:
    """Lambda tuned for a single cohort."""
    from duonet.networks import tune_one_group

    scaled = transform.autoscale(transform.log_transform(fx.matrix_m(spark, sf_dir))).where("group = 'F'")
    return tune_one_group(scaled)[0]


def correlation_collapse(spark, sf_dir) -> DataFrame:
    return aggregate.correlation_groups(fx.matrix_m(spark, sf_dir), 0.3)


def hybrid_collapse(spark, sf_dir) -> DataFrame:
    part = fx.table(spark, sf_dir, "part")
    knowledge = part.select(F.col("p_brand").alias("feature_id"), F.substring("p_brand", 1, 7).alias("feature_group")).distinct()
    return aggregate.correlation_groups(fx.matrix_m(spark, sf_dir), 0.3, knowledge)


def consensus_modules(spark, sf_dir) -> DataFrame:
    return experiment(spark, sf_dir).estimate_networks(aprox=True).cluster().summary()


def enrichment(spark, sf_dir) -> DataFrame:
    return experiment(spark, sf_dir).estimate_networks(aprox=True).cluster().enrich(min_size=2).enrichment_results()


QUERIES = {f.__name__: f for f in (diagnostics, bic_path, stability_probabilities, partial_corr_network, one_group_path, correlation_collapse, hybrid_collapse, consensus_modules, enrichment)}
