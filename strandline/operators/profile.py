"""Column-level quality profile of large tables, exact, per load.

Columns are unpivoted and counted by value, then sorted by range over (column, value). Each partition of the
sorted values carries its share of the cumulative curve of every load; prefix sums over the partitions
merge those shares. From the merged curves come exact quantiles, distinct counts and, between neighbouring loads,
the exact Kolmogorov-Smirnov distance and the total variation over given ranges.

A partition knows only relative curves: for a pair of loads it emits the total step of the difference of
both curves and the least and greatest value the difference takes inside. Where the partition starts on the curve
is added afterwards, so no task ever sees another partition, and nothing as long as the data leaves the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import cut, maybe_broadcast, shuffle_partitions

NULL_LIMIT, VIOLATION_LIMIT, DRIFT_LIMIT = 0.05, 0.03, 0.2


@dataclass(frozen=True)
class Profiled:
    """A column to profile: its domain, and the ranges in which drift is measured (none: by value)."""

    name: str
    numeric: bool
    in_domain: Callable[[Column], Column]
    edges: tuple[float, ...] = ()


@dataclass(frozen=True)
class Profile:
    """``summary`` by column and load; ``distances`` by column and load against the preceding load; ``quantiles``."""

    summary: DataFrame
    distances: DataFrame
    quantiles: DataFrame | None


def value_counts(frame: DataFrame, load: str, columns: Sequence[Profiled]) -> DataFrame:
    """``column, load, num, txt, good, n``: the rows of each load by column and value, combined before the shuffle.

    ``good`` is null for null values, else whether the value lies in the column's domain. Rows of a null load stay in no load.
    """
    parts = []
    for i, c in enumerate(columns):
        value = F.col(c.name)
        num = F.when(value == 0, F.lit(0.0)).otherwise(value.cast("double")) if c.numeric else F.lit(None).cast("double")
        txt = F.lit(None).cast("string") if c.numeric else value.cast("string")
        good = F.when(value.isNotNull(), F.coalesce(c.in_domain(value), F.lit(False)))
        parts.append(F.struct(F.lit(i).alias("column"), num.alias("num"), txt.alias("txt"), good.alias("good")))
    long = frame.where(F.col(load).isNotNull()).select(F.col(load).cast("bigint").alias("load"), F.explode(F.array(*parts)).alias("v"))
    return long.select("load", "v.*").groupBy("column", "load", "num", "txt", "good").agg(F.count(F.lit(1)).alias("n"))


def _summary(counts: DataFrame) -> DataFrame:
    """One row per column and load, with the load's place in the order of loads."""
    ok = F.col("good")
    rows = counts.groupBy("column", "load").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(ok.isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("n_violation"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("n_good"),
        F.count(F.when(ok, 1)).alias("n_distinct"),
        F.min(F.when(ok, F.col("num"))).alias("min_num"),
        F.max(F.when(ok, F.col("num"))).alias("max_num"),
        F.min(F.when(ok, F.col("txt"))).alias("min_txt"),
        F.max(F.when(ok, F.col("txt"))).alias("max_txt"),
    )
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy("load")))


CURVE = "kind int, column int, place int, bin int, seq int, step double, low double, high double"


def _curves(edges: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Relative curves of one partition of the sorted counts; see :func:`profile`.

    kind 0: a pair of loads, with the step of the difference of their curves and its extremes;
    kind 1: a pair of loads, with the difference of shares in a range (by value: the sum of absolute differences);
    kind 2: a load, with the number of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        seq = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            group = _groups(table)
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield _emit(table.slice(0, whole), group[:whole], edges, seq)
                seq += 1
            held = table.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield _emit(held, _groups(held), edges, seq)

    return run


def _groups(table: pa.Table) -> np.ndarray:
    """Number of the (column, value) group of each row of a sorted table."""
    new = np.zeros(table.num_rows, bool)
    for name in ("column", "num", "txt"):
        c = table.column(name).combine_chunks()
        same = pc.fill_null(pc.equal(c.slice(1), c.slice(0, len(c) - 1)), False)
        both = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, len(c) - 1)))
        new[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _emit(table: pa.Table, group: np.ndarray, edges: dict[int, np.ndarray], seq: int) -> pa.RecordBatch:
    number = lambda name: table.column(name).to_numpy()
    column, place, n, share = number("column").astype(np.int64), number("place").astype(np.int64), number("n").astype(float), number("n") / number("n_good")
    num = number("num").astype(float)
    bins = np.full(len(n), -1)
    for c, e in edges.items():
        at = column == c
        bins[at] = np.clip(np.searchsorted(e, num[at], side="right") - 1, 0, len(e) - 2)
    # each row steps the curve of its load in two pairs: (preceding, own) up and (own, following) down
    pair, delta = np.concatenate([place, place + 1]), np.concatenate([share, -share])
    col2, group2, bin2 = np.tile(column, 2), np.tile(group, 2), np.tile(bins, 2)
    order = np.lexsort((group2, pair, col2))
    pair, delta, col2, group2, bin2 = pair[order], delta[order], col2[order], group2[order], bin2[order]
    start = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (col2[1:] != col2[:-1])])
    last_of_value = np.r_[(group2[1:] != group2[:-1]) | (pair[1:] != pair[:-1]) | (col2[1:] != col2[:-1]), True]
    run = np.cumsum(delta)
    length = np.diff(np.r_[start, len(run)])
    run -= np.repeat(np.r_[0.0, run][start], length)
    low = np.minimum.reduceat(np.where(last_of_value, run, np.inf), start)
    high = np.maximum.reduceat(np.where(last_of_value, run, -np.inf), start)
    step = run[np.r_[start[1:], len(run)] - 1]
    parts = [(np.zeros(len(start)), col2[start], pair[start], np.zeros(len(start)), step, low, high)]
    key = np.where(bin2 >= 0, bin2, -1 - group2)
    order = np.lexsort((key, pair, col2))
    first = np.flatnonzero(np.r_[True, np.any([np.diff(x[order]) != 0 for x in (key, pair, col2)], axis=0)])
    moved = np.add.reduceat(delta[order], first)
    at = order[first]
    binned = bin2[at] >= 0
    zero = np.zeros(len(at))
    parts.append((zero + 1, col2[at], pair[at], np.where(binned, bin2[at], -1), np.where(binned, moved, np.abs(moved)), zero, zero))
    order = np.lexsort((place, column))
    first = np.flatnonzero(np.r_[True, np.any([np.diff(x[order]) != 0 for x in (place, column)], axis=0)])
    at, zero = order[first], np.zeros(len(first))
    parts.append((zero + 2, column[at], place[at], zero, np.add.reduceat(n[order], first), zero, zero))
    kind, c, p, b, s, lo, hi = (np.concatenate(x) for x in zip(*parts))
    whole = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays([whole(kind), whole(c), whole(p), whole(b), pa.array(np.full(len(c), seq, np.int32)), pa.array(s), pa.array(lo), pa.array(hi)], names=["kind", "column", "place", "bin", "seq", "step", "low", "high"])


def profile(frame: DataFrame, load: str, columns: Sequence[Profiled], quantiles: Sequence[float] = ()) -> Profile:
    """Profile the columns of a table by load.

    Rows count as delivered, with repeats. Ranges, distinct counts, quantiles (the least value whose share of
    values up to it reaches q) and distances concern values inside the domain. A load of which the preceding one, or it
    itself, has no such value has no distance. An empty table gives empty results; other columns are ignored.
    """
    spark = frame.sparkSession
    counts = cut(value_counts(frame, load, columns))
    summary = cut(_summary(counts))
    good = counts.where("good").select("column", "load", "num", "txt", "n").join(maybe_broadcast(summary.select("column", "load", "place", "n_good")), ["column", "load"])
    ordered = good.repartitionByRange(shuffle_partitions(spark), "column", "num", "txt").sortWithinPartitions("column", "num", "txt")
    if quantiles:
        ordered = cut(ordered.withColumn("pid", F.spark_partition_id()))
    edges = {i: np.array(c.edges) for i, c in enumerate(columns) if c.edges}
    curves = ordered.select("column", "place", "num", "txt", "n", "n_good").mapInArrow(_curves(edges), CURVE).withColumn("pid", F.spark_partition_id())
    curves = cut(curves)

    before = Window.partitionBy("column", "place").orderBy("pid", "seq").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("step").over(before), F.lit(0.0))
    ks = curves.where("kind = 0").withColumn("offset", offset).groupBy("column", "place").agg(F.max(F.greatest(F.abs(F.col("offset") + F.col("low")), F.abs(F.col("offset") + F.col("high")))).alias("ks"))
    moved = curves.where("kind = 1").groupBy("column", "place", "bin").agg(F.sum("step").alias("d")).groupBy("column", "place").agg((F.sum(F.abs("d")) / 2).alias("moved_share"))
    ordered_loads = Window.partitionBy("column").orderBy("place")
    pairs = summary.select("column", "load", "place", "n_good", F.lag("n_good").over(ordered_loads).alias("n_before")).where("n_good > 0 and n_before > 0")
    distances = pairs.join(ks, ["column", "place"]).join(moved, ["column", "place"]).select("column", "load", "ks", "moved_share")
    return Profile(summary, distances, _quantiles(ordered, curves, summary, quantiles) if quantiles else None)


def _quantiles(ordered: DataFrame, curves: DataFrame, summary: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """The value at each quantile: prefix counts tell the partition that holds it, and only its rows are searched."""
    counts = curves.where("kind = 2").groupBy("column", "place", "pid").agg(F.sum("step").alias("n_here"))
    upto = Window.partitionBy("column", "place").orderBy("pid")
    counts = counts.withColumn("done", F.sum("n_here").over(upto))
    wanted = summary.where("n_good > 0").select("column", "place", "load", "n_good", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    wanted = wanted.withColumn("rank", F.greatest(F.lit(1.0), F.ceil(F.round(F.col("q") * F.col("n_good"), 6)).cast("double")))
    targets = wanted.join(counts, ["column", "place"]).where("done >= rank and done - n_here < rank").select("column", "place", "pid", "load", "q", (F.col("rank") - F.col("done") + F.col("n_here")).alias("local"))
    inside = ordered.join(targets.select("column", "place", "pid").distinct(), ["column", "place", "pid"], "left_semi")
    running = Window.partitionBy("column", "place", "pid").orderBy("num", "txt")
    inside = inside.select("column", "place", "pid", "num", "txt", "n", F.sum("n").over(running).alias("upto"))
    hits = inside.join(targets, ["column", "place", "pid"]).where("upto >= local and upto - n < local")
    return hits.select("column", "load", "q", "num", "txt")


#: The profiled columns of the calls.
CALL_COLUMNS = (
    Profiled("prob_1", True, lambda v: v.between(0.0, 1.0) & ~F.isnan(v), tuple(i / 10 for i in range(11))),
    Profiled("called_label", True, lambda v: v.isin(0, 1)),
    Profiled("strand", False, lambda v: v.isin("+", "-", ".")),
)


def _names(columns: Sequence[Profiled]) -> Column:
    return F.array(*[F.lit(c.name) for c in columns])[F.col("column")]


def calls_profile(calls: DataFrame, columns: Sequence[Profiled] = CALL_COLUMNS, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per load and column: counts, rates, range, quantiles, and distances to the preceding load."""
    result = profile(calls, "load_id", columns, quantiles)
    wide = result.quantiles.groupBy("column", "load").agg(*[F.max(F.when(F.col("q") == q, F.col("num"))).alias(f"q{int(100 * q)}") for q in quantiles])
    value = lambda k: F.coalesce(F.col(f"{k}_num").cast("string"), F.col(f"{k}_txt")).alias(f"{k}_value")
    joined = result.summary.join(result.distances, ["column", "load"], "left").join(wide, ["column", "load"], "left")
    return joined.select(F.col("load").alias("load_id"), _names(columns).alias("col_name"), "n_rows", "n_null", "n_violation", F.col("n_distinct"), F.round("min_num", 6).alias("min_num"), F.round("max_num", 6).alias("max_num"), F.col("min_txt"), F.col("max_txt"), *[f"q{int(100 * q)}" for q in quantiles], F.round("ks", 6).alias("ks"), F.round("moved_share", 6).alias("moved_share"))


def load_issues(calls: DataFrame, columns: Sequence[Profiled] = CALL_COLUMNS, null_limit: float = NULL_LIMIT, violation_limit: float = VIOLATION_LIMIT, drift_limit: float = DRIFT_LIMIT) -> DataFrame:
    """``load_id, col_name, issue_kind``: null rates, domain violations and drift beyond their limits."""
    result = profile(calls, "load_id", columns)
    joined = result.summary.join(result.distances, ["column", "load"], "left")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("n_null") > null_limit * F.col("n_rows"), F.lit("null_rate")),
            F.when(F.col("n_violation") > violation_limit * F.col("n_rows"), F.lit("violation")),
            F.when(F.round("moved_share", 9) > drift_limit, F.lit("drift")),
        )
    )
    return joined.select(F.col("load").alias("load_id"), _names(columns).alias("col_name"), F.explode(kinds).alias("issue_kind"))
