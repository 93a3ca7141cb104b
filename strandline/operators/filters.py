"""Filters of calls and alignments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import maybe_broadcast


def contigs(frame: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), column: str = "chrom") -> DataFrame:
    """Rows of the included contigs (all if none is named) that are not excluded."""
    if include:
        frame = frame.where(F.col(column).isin(list(include)))
    return frame.where(~F.col(column).isin(list(exclude))) if exclude else frame


def at_positions(calls: DataFrame, positions: DataFrame) -> DataFrame:
    """Calls at listed positions, strand included. The list is broadcast only if it is small."""
    keys = positions.select("chrom", "pos", "strand").dropna().distinct()
    return calls.join(maybe_broadcast(keys), ["chrom", "pos", "strand"], "left_semi")


def is_primary(flag: Column) -> Column:
    """Neither a secondary nor a supplementary alignment."""
    return flag.bitwiseAND(0x900) == 0


def is_unmapped(flag: Column) -> Column:
    return flag.bitwiseAND(0x4) != 0


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(0x10) != 0


def good_alignments(alignments: DataFrame, mapq: int = 1, fraction: float = 0.5, identity: float = 0.0) -> DataFrame:
    """Primary alignments of enough quality; mapped ones also cover and match enough of their read.

    Needs ``flag, mapq, nm, query_length, aligned_start, aligned_end``.
    """
    aligned = F.col("aligned_end") - F.col("aligned_start")
    covered = F.try_divide(aligned, F.col("query_length")) >= fraction
    matched = 1 - F.try_divide(F.col("nm"), aligned) >= identity
    return alignments.where(is_primary(F.col("flag")) & (F.col("mapq") >= mapq) & (is_unmapped(F.col("flag")) | (covered & matched)))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides, those they share, and the share of the left ones."""
    both = left.select(key).dropna().distinct().withColumn("l", F.lit(1)).join(right.select(key).dropna().distinct().withColumn("r", F.lit(1)), key, "full")
    out = both.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"))
    return out.withColumn("share", F.round(F.try_divide("n_both", "n_left"), 6))
