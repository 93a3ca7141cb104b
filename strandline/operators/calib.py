"""Calls in the light of their neighbours on the same read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.blocks import blocked, with_halo

WIDTH = 11


def read_features(calls: DataFrame) -> DataFrame:
    """``readname, log_sites, mean_prob, std_prob``: log(1 + calls), mean and population deviation of prob_1 over the whole read."""
    return calls.groupBy("readname").agg(F.log1p(F.count(F.lit(1))).alias("log_sites"), F.avg("prob_1").alias("mean_prob"), F.stddev_pop("prob_1").alias("std_prob"))


def read_windows(calls: DataFrame, width: int = WIDTH) -> DataFrame:
    """Adds ``probs, offsets, valid``: the call and its neighbours by position on the same read and contig.

    Missing neighbours count as probability 0, offset 0, valid 0; offsets are absolute distances. A read may
    hold any share of the rows, even at one position: calls in order are cut into blocks of nearly equal size, and each block also gets
    copies of the nearest calls beside it.
    """
    side = width // 2
    key, order = ["readname", "chrom"], ["pos", "row_id"]
    both = with_halo(blocked(calls, key, order), key, order, side, ["prob_1"])
    w = Window.partitionBy(*key, "_block").orderBy(*order)
    at = lambda c, k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) if k else F.col(c)
    span = range(-side, side + 1)
    probs = F.array(*[F.coalesce(at("prob_1", k), F.lit(0.0)) for k in span])
    offsets = F.array(*[F.coalesce(F.abs(at("pos", k) - F.col("pos")), F.lit(0)).cast("double") for k in span])
    valid = F.array(*[F.when(at("pos", k).isNotNull(), 1.0).otherwise(0.0) for k in span])
    return both.withColumns({"probs": probs, "offsets": offsets, "valid": valid}).where("not _copy").drop("_copy", "_block")


def linear_scorer(probs: Column, offsets: Column, valid: Column, reach: float = 1000.0) -> Column:
    """A plain stand-in for a trained calibrator: the mean of the window's probabilities, weighted by nearness."""
    weights = F.zip_with(valid, offsets, lambda v, o: v / (1 + F.least(o / reach, F.lit(10.0))))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.zip_with(probs, weights, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x) / total


def rewrite(calls: DataFrame, probability: str) -> DataFrame:
    """Probabilities and label replaced by a calibrated probability of modification; calls without one pass through."""
    p1 = F.round(F.col(probability), 6)
    there = F.col(probability).isNotNull()
    return calls.withColumns({"prob_1": F.when(there, p1).otherwise(F.col("prob_1")), "prob_0": F.when(there, F.round(1 - p1, 6)).otherwise(F.col("prob_0")), "called_label": F.when(there, (p1 >= 0.5).cast("int")).otherwise(F.col("called_label"))})


def calibrated_all(calls: DataFrame, usable: Column, scorer) -> DataFrame:
    """All calls, those that are usable with calibrated probabilities and label, the others as they are.

    ``scorer(windows)`` adds ``score`` to calls with their windows; ``usable`` is null or false for calls without a place, a read or a probability.
    """
    marked = calls.withColumn("_usable", F.coalesce(usable, F.lit(False)))
    scored = rewrite(scorer(read_windows(marked.where("_usable"))), "score")
    return scored.select(*calls.columns).unionByName(marked.where("not _usable").select(*calls.columns))
