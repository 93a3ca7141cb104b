"""Rows in order, in blocks of nearly equal size, each with copies of the nearest rows beside it.

Windows that look a few rows to either side then need no more than a block, whatever share of the rows one key holds.
Blocks are ranges of the sorted rows, so a key with many rows spans many blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import cut, shuffle_partitions


def blocked(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``_block``: the range of the sort by keys and order in which a row lies.

    Ranges are drawn from a sample and would be drawn anew, so the result is cut.
    """
    return cut(frame.repartitionByRange(shuffle_partitions(frame.sparkSession), *keys, *order).withColumn("_block", F.spark_partition_id()))


def with_halo(rows: DataFrame, keys: Sequence[str], order: Sequence[str], side: int, carried: Sequence[str], marked: str | None = None) -> DataFrame:
    """Blocked rows, and copies of the nearest ``side`` rows of the same key before and behind each block, with ``_copy`` true.

    ``carried`` names the columns that copies keep (order included), the others are null. With ``marked`` only rows in which that
    column is true are copied. Blocks with fewer such rows are looked past. Only keys that lie in several blocks take part, and
    as blocks are ranges there are fewer of their (key, block) cells than twice the number of blocks.
    """
    cells = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    cells = cut(cells.withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_blocks") > 1).select(*keys, "_block"))
    own = rows if marked is None else rows.where(F.col(marked))
    first = Window.partitionBy(*keys, "_block").orderBy(*order)
    last = Window.partitionBy(*keys, "_block").orderBy(*[F.desc(c) for c in order])
    kept = [*order, *[c for c in carried if c not in order]]
    edge = own.join(F.broadcast(cells), [*keys, "_block"], "left_semi").select(*keys, "_block", *kept, F.row_number().over(first).alias("_f"), F.row_number().over(last).alias("_l")).where((F.col("_f") <= side) | (F.col("_l") <= side))
    edges = edge.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("_edge"))  # at most 2 * side rows
    up, down = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys).orderBy(F.desc("_block"))
    behind = F.flatten(F.collect_list("_edge").over(up.rowsBetween(0, side - 1)))
    before = F.flatten(F.collect_list("_edge").over(up.rowsBetween(1 - side, 0)))
    lists = edges.select(*keys, "_block", F.slice(behind, 1, side).alias("_onward"), before.alias("_upto")).withColumn("_upto", F.slice("_upto", F.greatest(F.lit(1), F.size("_upto") - side + 1), F.lit(side)))
    prior = Window.unboundedPreceding, -1
    known = cells.join(lists, [*keys, "_block"], "left")
    near = known.select(*keys, "_block", F.last("_upto", ignorenulls=True).over(up.rowsBetween(*prior)).alias("_left"), F.last("_onward", ignorenulls=True).over(down.rowsBetween(*prior)).alias("_right"))
    halo = near.select(*keys, "_block", F.explode(F.flatten(F.array_compact(F.array("_left", "_right")))).alias("_x"))
    copies = halo.select(*keys, "_block", "_x.*", F.lit(True).alias("_copy"))
    return rows.withColumn("_copy", F.lit(False)).unionByName(copies, allowMissingColumns=True)
