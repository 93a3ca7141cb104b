"""Column functions on arrays in general."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are summed by copying; longer arrays are cut into chunks of this size.
CHUNK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, not wherever a lambda names it."""
    return F.transform(F.array(value), use)[0]


def prefix_sums(values: Column, levels: int = 3) -> Column:
    """For each number of an array the sum of those before it.

    Arrays are cut into chunks whose sums are summed in the same way, so the work follows the length up to ``CHUNK ** (levels + 1)`` elements.
    """
    return let(values, lambda v: _summed(v, levels))


def _summed(values: Column, levels: int) -> Column:
    """The same of an array that is a variable; naming an expression here would compute it anew for every element."""
    zero = F.lit(0).cast("bigint")
    if levels == 0:
        return _copied(values, zero)
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda s: F.transform(F.sequence(s, F.least(s + CHUNK, F.size(values)) - 1), lambda j: F.get(values, j)))  # a slice would copy the whole array
    sums = lambda p: F.transform(p, lambda x: F.aggregate(x, zero, lambda a, v: a + v))
    long = let(parts, lambda p: let(sums(p), lambda t: F.flatten(F.zip_with(p, _summed(t, levels - 1), _copied))))
    return F.when(F.size(values) <= CHUNK, _copied(values, zero)).otherwise(long)


def _copied(values: Column, start: Column) -> Column:
    """The sums before each number from ``start`` on; copies the sums so far for every number."""
    none = F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(values, none, lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")), lambda a: a["all"])


def chunks(text: Column, size: int, more: int = 0) -> Column:
    """A text cut into pieces of ``size`` letters, each with up to ``more`` letters of what follows. One pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size + more}}})).{{1,{size}}}"), F.lit(1))


def centre_crop(values: Column, length: int, bias: int = 0) -> Column:
    """The ``length`` elements in the middle, moved by ``bias``."""
    first = F.floor((F.size(values) - length) / 2).cast("int") + bias
    return F.slice(values, F.greatest(first, F.lit(0)) + 1, F.lit(length))


def segment_of(lengths: Column, place: Column) -> Column:
    """``segment, offset`` of a place in segments laid end to end; null beyond the last one."""
    inside = lambda starts: F.filter(F.transform(starts, lambda s, i: F.struct(i.alias("segment"), (place - s).alias("offset"))), lambda x: (x["offset"] >= 0) & (x["offset"] < F.get(lengths, x["segment"])))
    return F.get(let(prefix_sums(F.transform(lengths, lambda n: n.cast("bigint"))), inside), 0)
