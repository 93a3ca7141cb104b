"""Column functions on arrays of signal samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.arrays import let
from strandline.functions.hashes import mixed

#: Fixed value: the 0.75 quantile of the standard normal distribution, which scales a MAD to a deviation.
MAD_TO_SIGMA = 0.6744897501960817


def _less(values: Column, m: Column, scale: Column | None = None) -> Column:
    """Values less a number, by another: both are computed once, not once per value inside the lambda."""
    n = F.size(values)
    shifted = F.zip_with(values, F.array_repeat(m, n), lambda x, c: x - c)
    return shifted if scale is None else F.zip_with(shifted, F.array_repeat(scale, n), lambda x, c: F.try_divide(x, c))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def deviation(values: Column) -> Column:
    """Population deviation."""
    return F.sqrt(F.try_divide(total(F.transform(_less(values, mean(values)), lambda x: x * x)), F.size(values)))


def median(values: Column) -> Column:
    s, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)


def standardised(values: Column) -> Column:
    """Less the mean, by the deviation; unchanged where the deviation is 0."""
    s = deviation(values)
    return F.when(s == 0, values).otherwise(_less(values, mean(values), s))


def mad_scaled(values: Column) -> Column:
    """Less the median, by the scaled median distance from it; unchanged where that is 0."""
    m = median(values)
    s = median(F.transform(_less(values, m), lambda x: F.abs(x))) / MAD_TO_SIGMA
    return F.when(s == 0, values).otherwise(_less(values, m, s))


def trimmed(values: Column, start: Column, end: Column) -> Column:
    """Without the first ``start`` samples, or without the last ones where it is negative; of what lies before sample ``end`` if that is not null."""
    n = F.least(F.size(values), F.coalesce(end, F.size(values)))
    first = F.greatest(start, F.lit(0))
    length = F.greatest(n - F.abs(start), F.lit(0))
    return F.slice(values, first + 1, length)


def picoamps(values: Column, span: Column, digits: Column, offset: Column) -> Column:
    """Raw samples in pA; unchanged where the calibration is missing."""
    scale = F.try_divide(span, digits)
    return F.when(scale.isNull() | offset.isNull(), values).otherwise(F.transform(values, lambda x: scale * (x + offset)))


def bounds(moves: Column, stride: Column, samples: Column) -> Column:
    """``begin, size`` in samples of each base: a base begins at each move of 1 and ends before the next one."""
    marks = F.filter(F.transform(moves, lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull())
    ends = F.transform(F.concat(F.slice(marks, 2, F.greatest(F.size(marks) - 1, F.lit(0))), F.array(F.size(moves))), lambda i: F.least(i * stride, samples))
    return F.transform(F.arrays_zip(marks.alias("b"), ends.alias("e")), lambda x: F.struct((x["b"] * stride).alias("begin"), F.greatest(x["e"] - x["b"] * stride, F.lit(0)).alias("size")))


def bases(values: Column, moves: Column, stride: Column) -> Column:
    """The samples of each base. Null where the first move is not 1."""
    cut = F.transform(bounds(moves, stride, F.size(values)), lambda b: F.slice(values, b["begin"] + 1, b["size"]))
    return F.when(F.try_element_at(moves, F.lit(1)) == 1, cut)


def thinned(values: Column, length: int) -> Column:
    """Evenly spaced samples of a longer array, first and last included."""
    n = F.size(values)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.element_at(values, F.floor(j * (n - 1) / F.lit(max(length - 1, 1))).cast("int") + 1))


def rectangle(groups: Column, length: int, pad: float = float("nan")) -> Column:
    """Each base as ``length`` places: longer ones thinned, shorter ones padded around the middle."""

    def row(g: Column) -> Column:
        n = F.size(g)
        left = F.floor((length - n) / 2).cast("int")
        padded = F.concat(F.array_repeat(F.lit(pad), left), g, F.array_repeat(F.lit(pad), F.lit(length) - n - left))
        return F.when(n > length, thinned(g, length)).otherwise(padded)

    return F.transform(groups, row)


def folded_trace(row: Column) -> Column:
    """Eight trace columns as four."""
    return F.zip_with(F.slice(row, 1, 4), F.slice(row, 5, 4), lambda a, b: a + b)


def base_probabilities(trace: Column, moves: Column) -> Column:
    """For each base the trace's four columns summed over its moves, as shares of their sum."""
    column_sums = lambda rows: F.aggregate(rows, F.array_repeat(F.lit(0.0), 4), lambda a, r: F.zip_with(a, r, lambda x, y: x + y))
    share = lambda sums: let(sums, lambda s: let(total(s), lambda n: F.transform(s, lambda x: F.try_divide(x, n))))
    rows = lambda b: F.slice(trace, b["begin"] + 1, b["size"])
    return F.when(F.try_element_at(moves, F.lit(1)) == 1, F.transform(bounds(moves, F.lit(1), F.size(trace)), lambda b: share(column_sums(rows(b)))))


def sampled(values: Column, length: int, seed: int = 0) -> Column:
    """``length`` random samples of a longer array in their order; a shorter one stays as it is. Repeatable: places go by a hash."""
    picked = F.slice(F.array_sort(F.transform(values, lambda _, i: F.struct(mixed(i.cast("bigint"), seed).alias("h"), i.alias("i")))), 1, length)
    return F.when(F.size(values) <= length, values).otherwise(F.transform(F.array_sort(F.transform(picked, lambda x: x["i"])), lambda i: F.get(values, i)))
