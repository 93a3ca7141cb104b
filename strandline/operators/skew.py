"""Keys that hold most rows: two-stage salted aggregation, and joins that split such keys.

A key that holds at least ``min_share`` of the rows is heavy; there can be at most ``1 / min_share``
of them, so their list is bounded whatever the size of the data. Candidates come from a mergeable sketch of frequent
items, which takes one pass over the keys and no shuffle of them. Rows of candidates get a salt, partial
results are computed for each (key, salt), and the partials are merged by the original key; that also makes counts exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import BROADCAST_BYTES, BROADCAST_ROWS, cut, is_small

MIN_SHARE = 0.01
SALTS = 64
#: Keys that the sketch follows: it errs by at most 3.5 / TRACKED of the rows, far below any share asked for.
TRACKED = 65_536

#: How partials of each kind are computed and merged.
PARTIAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Candidates:
    """Hashes of keys that may be heavy, every heavy key among them, and the number of all rows."""

    keys: tuple[str, ...]
    hashes: tuple[int, ...]
    total: int

    def contains(self) -> Column:
        """Whether a row's key is a candidate; false where a part of the key is null."""
        return _hash(self.keys).isin(list(self.hashes)) if self.hashes else F.lit(False)


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def candidates(frame: DataFrame, keys: Sequence[str], min_share: float = MIN_SHARE) -> Candidates:
    """The keys that may hold ``min_share`` of all rows of the frame.

    One pass: each task sketches the hashes of its keys, the sketches are merged, and at most ``2 / min_share`` items
    reach the driver. No heavy key is missed: the sketch's error is far below the share, and fewer than
    ``2 / min_share`` keys can stand before it. A key with a null part is no key, but its rows count in the total. An empty frame has none.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    most = max(1, min(TRACKED, int(2 / min_share)))
    sketched = frame.select(F.when(whole, _hash(keys)).alias("h"))
    top, total = sketched.agg(F.expr(f"approx_top_k(h, {most}, {TRACKED})"), F.count(F.lit(1))).first()
    return Candidates(tuple(keys), tuple(x["item"] for x in top or () if x["item"] is not None), total)


def heavy_counts(frame: DataFrame, keys: Sequence[str], spread: Sequence[str], min_share: float = MIN_SHARE) -> DataFrame:
    """``keys, n_rows`` of the keys that hold at least ``min_share`` of all rows: candidates of the sketch, counted exactly in two salted stages.

    Reads the frame twice. Rows with a null in a key count in the total only.
    """
    found = candidates(frame, keys, min_share)
    least = max(1, math.ceil(Fraction(str(min_share)) * found.total))
    counted = salted_aggregate(frame.where(found.contains()), keys, {"n_rows": ("count", F.lit(1))}, spread, min_share, heavy=found)
    return counted.where(F.col("n_rows") >= least)


def heavy_keys(frame: DataFrame, keys: Sequence[str], min_share: float = MIN_SHARE) -> list:
    """The keys that hold at least ``min_share`` of all rows, as rows of ``keys`` and ``n_rows``; at most ``1 / min_share`` reach the driver.

    Salts are hashes of all columns of the frame. An empty frame has no heavy keys.
    """
    return heavy_counts(frame, keys, frame.columns, min_share).collect()


def salted_aggregate(frame: DataFrame, keys: Sequence[str], aggregates: dict[str, tuple[str, Column]], spread: Sequence[str], min_share: float = MIN_SHARE, salts: int = SALTS, heavy: Candidates | None = None) -> DataFrame:
    """Results per key without a task that does most of the work.

    ``aggregates`` maps a name to a kind of :data:`PARTIAL` and its argument. ``spread`` names columns that
    tell rows of one key apart (a row id); their hash is the salt, so that a task that is run again
    salts as before. ``heavy`` names candidates that are known already. Rows with a null in a key are left out. Exact; an empty frame gives no rows.
    """
    keyed = frame.dropna(subset=list(keys))
    heavy = candidates(frame, keys, min_share) if heavy is None else heavy
    salt = F.when(heavy.contains(), F.pmod(F.xxhash64(*spread, F.lit(11)), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    partial = keyed.withColumn("_salt", salt).groupBy(*keys, "_salt").agg(*[PARTIAL[kind](column).alias(name) for name, (kind, column) in aggregates.items()])
    return partial.groupBy(*keys).agg(*[MERGE[kind](name).alias(name) for name, (kind, _) in aggregates.items()])


@dataclass(frozen=True)
class Side:
    """The right side of :func:`split_join`, computed once, and whether it may be broadcast."""

    frame: DataFrame
    small: bool

    def select(self, *columns) -> Side:
        """The same rows with other names; columns may be left out, none made longer."""
        return Side(self.frame.select(*columns), self.small)


def side(right: DataFrame, rows: int = BROADCAST_ROWS, ready: bool = False) -> Side:
    """Compute a side once (unless it is ``ready``, cut or read from a table), count and measure it."""
    right = right if ready else cut(right)
    return Side(right, is_small(right, rows, BROADCAST_BYTES))


def split_join(left: DataFrame, right: DataFrame | Side, key: str, how: str = "left", min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large left side to a right side that has one row per key.

    The right side is computed once, counted and measured. Up to ``broadcast_rows`` rows and ``BROADCAST_BYTES`` it is broadcast. Beyond
    that, the left rows of heavy keys meet a broadcast of just those keys' rows (at most ``2 / min_share``)
    and all others are joined by a shuffle on the key, in which no key holds more than ``min_share``.
    Null keys match nothing; with ``how="left"`` their rows stay.
    """
    known = right if isinstance(right, Side) else side(right, broadcast_rows)
    right = known.frame
    if known.small:
        return left.join(F.broadcast(right), key, how)
    at = candidates(left.select(key), [key], min_share).contains()
    hot = left.where(at).join(F.broadcast(right.where(at)), key, how)
    nulls = left.where(F.col(key).isNull())
    cold = left.where(~at & F.col(key).isNotNull()).join(right.where(~at), key, how)
    joined = hot.unionByName(cold)
    return joined if how == "inner" else joined.unionByName(nulls, allowMissingColumns=True)
