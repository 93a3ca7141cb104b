"""A sample whose category shares match given targets.

Each row gets a random rank in its category; its priority is (rank - 1/2) / target, so that taking the smallest
priorities over all categories is the divisor method of rounding. Rows up to the category's minimum come before
all others. Seats that an exhausted category cannot fill go to the next priorities of the others by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.ranks import first_rows, mixed, with_rank
from strandline.session import cut, maybe_broadcast

CATEGORY = ["k_mer5", "methy_label"]


def population(features: DataFrame) -> DataFrame:
    """``row_id, k_mer5, methy_label`` of the rows with a k_mer of 21 letters and a label of 0 or 1."""
    usable = features.where(F.col("k_mer").rlike("^[A-Za-z]{21}$") & F.col("methy_label").isin(0, 1))
    return usable.select("row_id", F.upper(F.substring("k_mer", 9, 5)).alias("k_mer5"), F.col("methy_label").cast("int").alias("methy_label"))


def needs(rows: DataFrame, targets: DataFrame, divisor: int = 10) -> tuple[DataFrame, int]:
    """Each target category with the rows it has and the rows it needs, and the size of the sample.

    The sample has as many rows as the population divided by ``divisor``, rounded down. A category needs the larger of its
    minimum and its share of the sample rounded up; the product is exact in decimals. Repeated targets add up.
    """
    counts = cut(rows.groupBy(*CATEGORY).agg(F.count(F.lit(1)).alias("n_available")))
    size = (counts.agg(F.sum("n_available")).first()[0] or 0) // divisor
    wanted = targets.where("k_mer5 is not null and methy_label is not null").groupBy("k_mer5", F.col("methy_label").cast("int").alias("methy_label"))
    wanted = wanted.agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("min_rows"), F.lit(0)).alias("min_rows"))
    share = F.ceil(F.col("target_share").cast("decimal(18,9)") * F.lit(size).cast("decimal(18,0)")).cast("bigint")
    joined = wanted.join(counts, CATEGORY, "left").withColumn("n_available", F.coalesce("n_available", F.lit(0)))
    return joined.withColumn("n_needed", F.greatest(F.col("min_rows").cast("bigint"), share)), size


def ranked(rows: DataFrame, seed: int = 5) -> DataFrame:
    """The population with ``rank``: each row's place, from 1, in the random order of its category."""
    return with_rank(rows, CATEGORY, ["row_id"], order=mixed(F.col("row_id"), seed))


def _priority() -> Column:
    return F.try_divide(F.col("rank") - 0.5, F.col("target_share"))


def draw(features: DataFrame, targets: DataFrame, divisor: int = 10, seed: int = 5) -> DataFrame:
    """``row_id, k_mer5, methy_label, rank, priority`` of the sample, without repeated rows of one id.

    The rows of the globally smallest keys: rows inside their category's minimum first, then by priority; equal
    priorities stand by category. Beyond its minimum a category without a share gives no rows. Rows of categories without a
    target are not drawn. An empty population gives an empty sample.
    """
    rows = population(features)
    wanted, size = needs(rows, targets, divisor)
    return _drawn(ranked(rows, seed), wanted, size)


def _drawn(ranks: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    joined = ranks.join(maybe_broadcast(wanted.select(*CATEGORY, "target_share", "min_rows")), CATEGORY)  # one row per target
    beyond = F.col("rank") > F.col("min_rows")
    eligible = joined.where(~beyond | (F.col("target_share") > 0)).select("row_id", *CATEGORY, "rank", _priority().alias("priority"), beyond.alias("_beyond"))
    keys = [F.col("_beyond"), F.coalesce("priority", F.lit(float("inf"))), *[F.col(c) for c in CATEGORY], F.col("rank")]
    return first_rows(eligible, keys, size).drop("_beyond")


def report(features: DataFrame, targets: DataFrame, divisor: int = 10, seed: int = 5) -> DataFrame:
    """Each target with what it has, needs and gives, its share of the sample, and whether it can be met without repeating rows.

    What a category has is its greatest rank, which must be its number of rows, else the query fails.
    """
    rows = population(features)
    wanted, size = needs(rows, targets, divisor)
    ranks = cut(ranked(rows, seed))
    reached = ranks.groupBy(*CATEGORY).agg(F.max("rank").alias("_reached"))
    drawn = _drawn(ranks, wanted, size).groupBy(*CATEGORY).agg(F.count(F.lit(1)).alias("n_drawn"))
    joined = wanted.join(reached, CATEGORY, "left").join(drawn, CATEGORY, "left").fillna(0, ["_reached", "n_drawn"])
    has = F.when(F.col("_reached") == F.col("n_available"), F.col("_reached")).otherwise(F.raise_error(F.lit("ranks differ from the rows of a category")).cast("bigint"))
    whole = drawn.agg(F.coalesce(F.sum("n_drawn"), F.lit(0)).alias("n_sample"))
    out = joined.join(F.broadcast(whole)).withColumn("n_available", has)  # one row
    return out.select(*CATEGORY, "target_share", "min_rows", "n_available", "n_needed", "n_drawn", F.round(F.try_divide("n_drawn", "n_sample"), 6).alias("drawn_share"), (F.col("n_available") >= F.col("n_needed")).alias("is_met"))


def unmet(features: DataFrame, targets: DataFrame, divisor: int = 10, seed: int = 5) -> DataFrame:
    """``k_mer5, methy_label`` of the categories that cannot be met without repeating rows, from the report of the sample."""
    return report(features, targets, divisor, seed).where(~F.col("is_met")).select(*CATEGORY)
