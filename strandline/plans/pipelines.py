"""Whole pipelines: from calls to frequencies and calibrated calls, and from features to calls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import seq
from strandline.operators import calib, freq
from strandline.operators.skew import split_join
from strandline.plans import extract
from strandline.scorers import hte, models
from strandline.scorers.layers import Weights
from strandline.session import spread
from strandline.sources import text


def site_frequencies(calls: DataFrame, weights: Weights, min_coverage: int = freq.MIN_COVERAGE) -> DataFrame:
    """bedMethyl rows by the site estimator: histograms, anchor windows, scores. Unmapped sites stay away."""
    windows = freq.site_windows(freq.site_histograms(calls, min_coverage=min_coverage)).where("pos >= 0")

    def run(w: Weights, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["chrom", "pos", "coverage"]].assign(frequency=models.score_sites(w, models.stacked(pdf["hist"]), models.stacked(pdf["dist"])))

    scored = models.score(windows, weights, run, "chrom string, pos bigint, coverage bigint, frequency double")
    strands = freq.majority_strand(calls).select("chrom", "pos", "strand")
    return freq.bed(scored.join(strands, ["chrom", "pos"]), "frequency")


def calibrated(calls: DataFrame, weights: Weights) -> DataFrame:
    """Calls with probabilities and labels rewritten by the read calibrator, one row per call."""
    windows = calib.read_windows(calls)
    joined = split_join(windows, calib.read_features(calls), "readname", "inner")

    def run(w: Weights, pdf: pd.DataFrame) -> pd.DataFrame:
        read = pdf[["log_sites", "mean_prob", "std_prob"]].to_numpy(float)
        return pdf[["row_id", "prob_0", "prob_1", "called_label"]].assign(score=models.score_calls(w, models.stacked(pdf["probs"]), models.stacked(pdf["offsets"]), models.stacked(pdf["valid"]), read))

    narrow = joined.select("row_id", "prob_0", "prob_1", "called_label", "probs", "offsets", "valid", "log_sites", "mean_prob", "std_prob")
    scored = models.score(narrow, weights, run, "row_id bigint, prob_0 double, prob_1 double, called_label int, score double")
    return calib.rewrite(scored, "score").drop("score")


def calibrated_lines(spark: SparkSession, paths: list[str], scorer, name_part: str = "") -> DataFrame:
    """``row_id, value``: the lines of call files with calibrated probabilities and label; lines that do not parse pass through as they are.

    ``scorer(windows)`` adds ``score``. Row ids follow files and lines, so sorting by them gives the order of the input.
    """
    rows = text.read_calls(spark, paths, name_part)
    scored = calib.rewrite(scorer(calib.read_windows(rows.where("reject is null"))), "score")
    return scored.select("row_id", text.call_line().alias("value")).unionByName(rows.where("reject is not null").select("row_id", F.col("raw").alias("value")))


def called_reads(signals: DataFrame, alignments: DataFrame, scorer, settings: extract.Settings = extract.Settings(), positions: DataFrame | None = None) -> DataFrame:
    """Calls from signals and alignments: features of all sites, scored by ``scorer(features) -> row_id, prob_0, prob_1, called_label, k_mer``.

    Places without a sample are NaN, for scorers that mask them. A site is known by its read, contig, place and strand, whose hash is the row id
    of its features; the scores meet their sites by it.
    """
    rows = extract.features(signals, alignments, settings, positions=positions, padding=float("nan"))
    keyed = rows.withColumn("row_id", F.xxhash64("readname", "chrom", "pos", "strand", "loc"))
    scored = scorer(keyed).select("row_id", "prob_0", "prob_1", "called_label", F.col("k_mer").alias("_centre"))
    sites = keyed.select("row_id", "chrom", "pos", "strand", "pos_in_strand", "readname", "read_loc", "loc")
    return sites.join(scored, "row_id").select("chrom", "pos", "strand", "pos_in_strand", "readname", "read_loc", "prob_0", "prob_1", "called_label", F.col("_centre").alias("k_mer"), "loc")


def _shaped(features: DataFrame) -> DataFrame:
    """Rows whose k-mer and arrays have the models' shape, with letter codes and the middle of the k-mer."""
    whole = (F.size("signal_means") == 21) & (F.size("signal_stds") == 21) & (F.size("signal_lens") == 21) & (F.size("raw_signals") == 21) & F.forall("raw_signals", lambda r: F.size(r) == 15)
    rows = features.where(F.col("k_mer").rlike("^[A-Za-z]{21}$") & whole)
    return rows.select("row_id", F.transform(seq.codes(F.upper("k_mer")), lambda c: F.greatest(c, F.lit(0))).alias("codes"), "signal_means", "signal_stds", "signal_lens", "raw_signals", F.coalesce(F.col("tag"), F.lit(1)).alias("tag"), seq.centre(F.upper("k_mer")).alias("k_mer"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _cleaned(values: Column) -> Column:
    """Numbers that are not finite, and nulls, as 0."""
    return F.transform(values, lambda x: F.when(_finite(x.cast("double")), x.cast("double")).otherwise(0.0))


def _recorded(samples: Column, length: Column) -> Column:
    """The samples of a base, NaN where none is recorded: ``length`` of the 15 places are, in the middle."""
    n = F.least(length, F.lit(15))
    first = F.floor((15 - n) / 2)
    return F.transform(samples, lambda x, at: F.when(length.isNotNull() & (at >= first) & (at < first + n) & _finite(x.cast("double")), x.cast("double")).otherwise(float("nan")))


#: Tasks a core by the temporal encoder, which takes some 20 ms or more a row.
ENCODER_TASKS = 8
CALLED = "row_id bigint, prob_0 double, prob_1 double, called_label int, k_mer string"


def _as_calls(pdf: pd.DataFrame, p: np.ndarray) -> pd.DataFrame:
    """Probabilities to six places; equal ones are no modification."""
    p1 = np.round(p[:, 1], 6)
    return pd.DataFrame({"row_id": pdf["row_id"], "prob_0": np.round(1 - p1, 6), "prob_1": p1, "called_label": (p[:, 1] > p[:, 0]).astype("int32"), "k_mer": pdf["k_mer"]})


def called(features: DataFrame, weights: Weights) -> DataFrame:
    """``row_id, prob_0, prob_1, called_label, k_mer`` of feature rows by the recurrent caller; rows of another shape are left out."""

    def run(w: Weights, pdf: pd.DataFrame) -> pd.DataFrame:
        return _as_calls(pdf, models.score_features(w, models.stacked(pdf["codes"]).astype(int), *(models.stacked(pdf[c]) for c in ("signal_means", "signal_stds", "signal_lens", "raw_signals"))))

    clean = {c: _cleaned(F.col(c)) for c in ("signal_means", "signal_stds", "signal_lens")} | {"raw_signals": F.transform("raw_signals", _cleaned)}
    return models.score(spread(_shaped(features)).withColumns(clean), weights, run, CALLED)


def called_by_encoder(features: DataFrame, weights: Weights) -> DataFrame:
    """The same by the temporal encoder, which also takes the proximity tag; places without a recorded sample are masked."""

    def run(w: Weights, pdf: pd.DataFrame) -> pd.DataFrame:
        return _as_calls(pdf, hte.probabilities(w, models.stacked(pdf["raw_signals"]), models.stacked(pdf["codes"]).astype(int), pdf["tag"].to_numpy(float)))

    rows = spread(_shaped(features).select("row_id", "codes", "signal_lens", "raw_signals", "tag", "k_mer"), ENCODER_TASKS)
    masked = rows.select("row_id", "codes", F.zip_with("raw_signals", "signal_lens", _recorded).alias("raw_signals"), "tag", "k_mer")
    return models.score(masked, weights, run, CALLED)
