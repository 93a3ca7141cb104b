"""Methylation frequency per site, and the histograms and neighbour windows of sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.blocks import blocked, with_halo
from strandline.operators.ranks import placed
from strandline.operators.skew import split_join

BINS = 20
SIDE = 5
PAD_DISTANCE = 10_000
MIN_COVERAGE = 4
EPSILON = 1e-8


def usable(calls: DataFrame) -> DataFrame:
    """Calls whose typed columns are whole: a site, a read, both probabilities in 0..1 and a label of 0 or 1."""
    inside = lambda c: F.col(c).between(0.0, 1.0) & ~F.isnan(c)
    return calls.where(F.col("chrom").isNotNull() & F.col("pos").isNotNull() & F.col("readname").isNotNull() & inside("prob_0") & inside("prob_1") & F.col("called_label").isin(0, 1))


def unambiguous(calls: DataFrame, least: float = 0.5) -> DataFrame:
    """Calls whose two probabilities differ by at least ``least``."""
    return calls.where(F.abs(F.col("prob_0") - F.col("prob_1")) >= least)


def site_counts(calls: DataFrame, least: float = 0.5) -> DataFrame:
    """Sums, counts and frequency of each site; strand, place in the strand and k-mer are those of its first row.

    Sites are keyed by contig and position, without strand; ``row_id`` tells rows apart, and rows without a site are left out.
    One shuffle of partial sums, which hash aggregation keeps unsorted; the first rows then meet their sites by row id.
    """
    kept = unambiguous(calls, least).where("chrom is not null and pos is not null")
    sums = kept.groupBy("chrom", "pos").agg(
        F.sum("prob_0").alias("prob_0_sum"), F.sum("prob_1").alias("prob_1_sum"), F.count_if(F.col("called_label") == 1).alias("count_modified"), F.count_if(F.col("called_label") == 0).alias("count_unmodified"), F.count(F.lit(1)).alias("coverage"), F.min("row_id").alias("row_id")
    )
    first = kept.select("row_id", "chrom", "pos", "strand", "pos_in_strand", "k_mer")
    return sums.join(first, ["row_id", "chrom", "pos"]).select("chrom", "pos", "strand", "pos_in_strand", "prob_0_sum", "prob_1_sum", "count_modified", "count_unmodified", "coverage", (F.col("count_modified") / F.col("coverage")).alias("modification_frequency"), "k_mer")


def sorted_sites(sites: DataFrame) -> DataFrame:
    """Sites with their ``place`` in the order of contig (by letters) and position (by number); partitions are ranges, sorted inside, for writing."""
    return placed(sites, [F.col("chrom"), F.col("pos")])


def check_counts(sites: DataFrame) -> DataFrame:
    """The sites, each with as many modified and unmodified calls as its coverage; the query fails otherwise."""
    whole = F.col("coverage") == F.col("count_modified") + F.col("count_unmodified")
    return sites.withColumn("coverage", F.when(whole, F.col("coverage")).otherwise(F.raise_error(F.concat(F.lit("counts differ from the coverage at "), F.col("chrom"), F.lit(" "), F.col("pos"))).cast("bigint")))


def percent(frequency: Column) -> Column:
    """Whole percent, halves to even after a small upward shift."""
    return F.bround(frequency * 100 + 0.001, 0).cast("int")


def bed(sites: DataFrame, frequency: str = "modification_frequency") -> DataFrame:
    """The bedMethyl columns of sites."""
    end = F.col("pos") + 1
    return sites.select("chrom", F.col("pos").alias("start"), end.alias("end"), F.lit(".").alias("name"), F.col("coverage").alias("score"), "strand", F.col("pos").alias("thick_start"), end.alias("thick_end"), F.lit("0,0,0").alias("rgb"), "coverage", percent(F.col(frequency)).alias("percent"))


def usage(calls: DataFrame, least: float = 0.5) -> DataFrame:
    """Calls used and in all, and their ratio (null without any call)."""
    used = F.count_if(F.abs(F.col("prob_0") - F.col("prob_1")) >= least)
    return calls.agg(used.alias("n_used"), F.count(F.lit(1)).alias("n_calls")).withColumn("ratio", F.round(F.try_divide("n_used", "n_calls"), 6))


def majority_strand(calls: DataFrame) -> DataFrame:
    """The most frequent strand of each site; of equally frequent ones the first seen."""
    counts = calls.where("strand is not null").groupBy("chrom", "pos", "strand").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
    return counts.groupBy("chrom", "pos").agg(F.max_by("strand", F.struct("n", -F.col("first_row"))).alias("strand"), F.sum("n").alias("coverage"))


def edges(bins: int = BINS) -> list[float]:
    """Edges of equal bins over 0..1, as literals shared by engine and SQL."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def histogram(probability: Column, bins: int = BINS) -> Column:
    """Counts by bin, as an aggregate: bins are told by comparing with their edges, the last is closed."""
    e = edges(bins)
    return F.array(*[F.count_if((probability >= e[i]) & ((probability < e[i + 1]) if i < bins - 1 else (probability <= e[i + 1]))) for i in range(bins)])


def unit_length(values: Column) -> Column:
    """An array scaled to length 1 (nearly: a small constant keeps empty ones finite), to six places."""
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)) + EPSILON
    return F.zip_with(values, F.array_repeat(norm, F.size(values)), lambda x, n: F.round(x / n, 6))


def site_histograms(calls: DataFrame, bins: int = BINS, min_coverage: int = MIN_COVERAGE) -> DataFrame:
    """``chrom, pos, coverage, hist, is_anchor``: scaled histogram of each site and whether it is covered well."""
    counted = calls.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("coverage"), histogram(F.col("prob_1"), bins).alias("counts"))
    hist = unit_length(F.transform("counts", lambda x: x.cast("double"))).alias("hist")
    return counted.select("chrom", "pos", "coverage", hist, (F.col("coverage") >= min_coverage).alias("is_anchor"))


def _between_anchors(sites: DataFrame, side: int) -> DataFrame:
    """Sites with ``near_<slot>`` for slots -side..-1 and 1..side: position and histogram of the anchors before and after; null beyond the last one.

    Sites in order are cut into blocks of nearly equal size, each with copies of the nearest anchors beside it, so
    one window over a block tells all slots and no contig has to sit in one task.
    """
    order = ["pos"]
    both = with_halo(blocked(sites, ["chrom"], order), ["chrom"], order, side, ["hist", "is_anchor"], "is_anchor")
    anchors = both.withColumn("_anchor", F.when(F.col("is_anchor"), F.struct("pos", "hist")))
    place = "ignore nulls over (partition by chrom, _block order by pos)"
    near = {f"near_{k}": F.expr(f"{'lag' if k < 0 else 'lead'}(_anchor, {abs(k)}) {place}") for k in [*range(-side, 0), *range(1, side + 1)]}
    return anchors.withColumns(near).where("not _copy").drop("_copy", "_block", "_anchor")


def anchor_neighbours(sites: DataFrame, side: int = SIDE) -> DataFrame:
    """``chrom, pos, slot, near_pos, near_hist``: the nearest anchors before (slots -side..-1) and after (1..side) each site.

    Slots without an anchor are absent; a site that is an anchor is not its own neighbour.
    """
    slots = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.col(f"near_{k}").alias("near")) for k in [*range(-side, 0), *range(1, side + 1)]])).alias("x")
    found = _between_anchors(sites, side).select("chrom", "pos", slots).where("x.near is not null")
    return found.select("chrom", "pos", "x.slot", F.col("x.near.pos").alias("near_pos"), F.col("x.near.hist").alias("near_hist"))


def with_anchor_rank(sites: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Adds ``rank_before``: the anchors strictly before the site on its contig."""
    blocked = sites.withColumn("_block", F.floor(F.col("pos") / block))
    totals = blocked.groupBy("chrom", "_block").agg(F.sum(F.col("is_anchor").cast("bigint")).alias("_n"))
    prior = Window.partitionBy("chrom").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("chrom", "_block", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("chrom", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("_offset") + F.coalesce(F.sum(F.col("is_anchor").cast("bigint")).over(inside), F.lit(0))
    return blocked.join(totals, ["chrom", "_block"]).withColumn("rank_before", rank).drop("_block", "_offset")


def site_windows(sites: DataFrame, side: int = SIDE, bins: int = BINS, pad: int = PAD_DISTANCE) -> DataFrame:
    """``chrom, pos, dist, hist``: each site between its neighbouring anchors, 2 * side + 1 places long.

    Missing neighbours are zero histograms ``pad`` before the first or behind the last site of the contig.
    Distances are absolute; the site itself stands in the middle.
    """
    ends = sites.groupBy("chrom").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    joined = split_join(_between_anchors(sites, side), ends, "chrom", "inner")
    zero = F.array_repeat(F.lit(0.0), bins)

    def slot(k: int) -> tuple[Column, Column]:
        if k == 0:
            return F.lit(0).cast("bigint"), F.col("hist")
        away = F.col("first_pos") - pad if k < 0 else F.col("last_pos") + pad
        return F.abs(F.coalesce(F.col(f"near_{k}.pos"), away) - F.col("pos")), F.coalesce(F.col(f"near_{k}.hist"), zero)

    parts = [slot(k) for k in range(-side, side + 1)]
    return joined.select("chrom", "pos", "coverage", F.array(*[d for d, _ in parts]).alias("dist"), F.array(*[h for _, h in parts]).alias("hist"))
