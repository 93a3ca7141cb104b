"""Running totals and ranks in a random but repeatable order, without a sort of the whole table in one task.

The order is that of a hash. Its leading bits are a bucket; buckets are summed, their prefix sums taken (a bounded
number of rows for each group), and only the order inside a bucket is left to a window: 1 / 65536 of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.hashes import MASK, mixed, mixed_sql  # noqa: F401
from strandline.session import cut, shuffle_partitions

BUCKETS = 1 << 16
def hash_bucket(tie: Sequence[str], seed: int = 0, buckets: int = BUCKETS) -> Column:
    """The bucket of a row in hash order."""
    return _bucket(_hash(tie, seed), buckets)


def _hash(tie: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*tie, F.lit(seed)).bitwiseAND(MASK)


def _bucket(order: Column, buckets: int) -> Column:
    return F.floor(order * buckets / (MASK + 1)).cast("int")


def with_running_total(frame: DataFrame, group: Sequence[str], tie: Sequence[str], amount: Column, seed: int = 0, buckets: int = BUCKETS, order: Column | None = None) -> DataFrame:
    """Adds ``running_before``: the sum of ``amount`` over the rows that come earlier in the group's hash order.

    ``tie`` names columns that tell rows apart; their hash with ``seed`` makes the order, or ``order`` does, a number in
    0..2^32-1. Rows of equal order stand by ``tie``. A null amount counts as 0.
    """
    hashed = frame.withColumn("_hash", _hash(tie, seed) if order is None else order).withColumn("_amount", F.coalesce(amount, F.lit(0)))
    hashed = hashed.withColumn("_bucket", _bucket(F.col("_hash"), buckets))
    sums = hashed.groupBy(*group, "_bucket").agg(F.sum("_amount").alias("_here"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_bucket", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_hash", *tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = hashed.join(sums, [*group, "_bucket"])
    return joined.withColumn("running_before", F.col("_offset") + F.coalesce(F.sum("_amount").over(inside), F.lit(0))).drop("_hash", "_bucket", "_amount", "_offset")


def with_rank(frame: DataFrame, group: Sequence[str], tie: Sequence[str], seed: int = 0, buckets: int = BUCKETS, order: Column | None = None) -> DataFrame:
    """Adds ``rank``: 1, 2, ... in the group's hash order."""
    return with_running_total(frame, group, tie, F.lit(1), seed, buckets, order).withColumn("rank", F.col("running_before") + 1).drop("running_before")


def placed(frame: DataFrame, keys: Sequence[Column], into: str = "place") -> DataFrame:
    """Adds each row's place, from 0, in the order of ``keys``, which should tell rows apart.

    Rows are sorted by range; the numbers of rows of the ranges (one count a partition) tell where each range begins,
    so neither the driver nor one task ever holds all rows.
    """
    spark = frame.sparkSession
    ordered = frame.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    # sorted once and cut: ranges are drawn anew whenever they are computed
    known = cut(ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_here", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = known.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return known.join(F.broadcast(starts), "_pid").withColumn(into, F.col("_start") + F.col("_here")).drop("_pid", "_here", "_start")


def first_rows(frame: DataFrame, keys: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` first rows in the order of ``keys``, which tell rows apart; all if there are fewer."""
    return placed(frame, keys, "_place").where(F.col("_place") < n).drop("_place")
