"""Queries that run scorers with seeded weights; SQL cannot express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.operators import freq
from strandline.plans import pipelines
from strandline.scorers import hte, models
from strandline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def aggr_score(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.site_frequencies(freq.usable(table(spark, d, "calls")), models.site_weights())


def calib_score(spark: SparkSession, d: str) -> DataFrame:
    calls = freq.usable(table(spark, d, "calls")).select("row_id", "readname", "chrom", "pos", "prob_0", "prob_1", "called_label")
    return pipelines.calibrated(calls, models.calibrator_weights())


def bilstm_score(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.called(table(spark, d, "features"), models.caller_weights())


def hte_score(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.called_by_encoder(table(spark, d, "features"), hte.weights())


QUERIES: dict[str, Query] = {q.__name__: q for q in (aggr_score, calib_score, bilstm_score, hte_score)}
ORACLES: dict[str, str] = {}
