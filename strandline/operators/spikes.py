"""Implausible values in measurements, judged against the normal behaviour of their source.

Each source (a read) has a state-space model for each field: a level that reverts to the source's
own centre, observed with noise. Centre, scale and the noise's share of the variance come from quartiles of all plausible
values of the source and from their usual steps, merged over the whole table. A Kalman filter runs over the bases of a row
(for raw signals over all recorded samples in turn), starting at the source's stationary state, and flags

* ``spike``      a standardised innovation beyond the threshold; the update is withheld, so that the
                 level keeps its course,
* ``stuck``      innovations of the persistent forecast (the level is the last value) whose variance vanishes over
                 ``min_run`` neighbours; equality of the values confirms it exactly,
* ``impossible`` a value that is not finite, or a negative deviation.

The filter is vectorised over the rows of an Arrow batch: a row is an independent stretch of its source,
as rows are sites apart on the read, and the level forgets a state within a few steps. So no source ever has to sit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.names import read_key
from strandline.operators.skew import split_join

FIELDS = ("signal_means", "signal_stds", "raw_signals")
QUARTILE_TO_SIGMA = 1.349
#: Reversion of the level to the centre from one value to the next.
REVERSION = 0.5
#: Bounds of the noise's share of a source's variance, and the share where the data do not tell it.
LEAST_NOISE, MOST_NOISE, UNKNOWN_NOISE = 0.3, 0.9, 0.5
INNOVATION_LIMIT = 6.0
#: A variance of innovations vanishes below this share of the values' own squares.
VANISHING = 1e-24
MIN_RUN = 5


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists of a column (null: 0) and their elements."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _fill(lengths: np.ndarray, flat: np.ndarray, width: int, missing: float) -> np.ndarray:
    if len(flat) == len(lengths) * width and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.full((len(lengths), width), missing, flat.dtype)
    at = np.arange(width) < lengths[:, None]
    out[at] = flat
    return out


def _floats(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values with NaN for null, and which of them are there."""
    there = values.is_valid().to_numpy(zero_copy_only=False)
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False), there


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of a column of lists, as arrays (rows, longest list)."""
    lengths, values = _lists(column)
    flat, there = _floats(values)
    width = int(lengths.max(initial=0))
    return _fill(lengths, flat, width, np.nan), _fill(lengths, there, width, False)


def _samples(raw: pa.Array, lens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Raw samples as (rows, bases, places) and which of them are recorded.

    Of a base with n samples, min(n, places) stand in the middle of its places; other places mean nothing.
    """
    bases, inner = _lists(raw)
    places, values = _lists(inner)
    flat, there = _floats(values)
    width, depth = int(bases.max(initial=0)), int(places.max(initial=0))
    value, present = _fill(places, flat, depth, np.nan), _fill(places, there, depth, False)
    counts, known = _matrix(lens)
    n = np.zeros((len(bases), width))
    w = min(width, counts.shape[1])
    n[:, :w] = np.where(known[:, :w], counts[:, :w], 0)
    at = np.arange(width) < bases[:, None]
    n = np.clip(n[at], 0, places)[:, None]
    first = (places[:, None] - n) // 2
    index = np.arange(depth)
    present &= (index >= first) & (index < first + n)
    full, kept = np.full((len(bases), width, depth), np.nan), np.zeros((len(bases), width, depth), bool)
    full[at], kept[at] = value, present
    return full, kept


def _vanishing(values: np.ndarray, there: np.ndarray, least: int) -> np.ndarray:
    """Where the innovations of the persistent forecast vanish over at least ``least`` neighbours of a row.

    The forecast of a value is the one before it; the variance of its innovations is taken over windows of
    ``least`` values. Equality of the window's values confirms a variance of rounding size.
    """
    n, width = values.shape
    out = np.zeros((n, width), bool)
    if width < least:
        return out
    pair = there[:, 1:] & there[:, :-1] & np.isfinite(values[:, 1:]) & np.isfinite(values[:, :-1])
    innovation = np.where(pair, np.subtract(values[:, 1:], values[:, :-1], where=pair, out=np.zeros(pair.shape)), np.inf)
    same = pair & (innovation == 0)
    windows = width - least + 1
    variance, size, exact = np.zeros((n, windows)), np.zeros((n, windows)), np.ones((n, windows), bool)
    for k in range(least - 1):
        variance += innovation[:, k : k + windows] ** 2
        size += np.where(pair[:, k : k + windows], values[:, k : k + windows], 0.0) ** 2
        exact &= same[:, k : k + windows]
    stuck = (variance <= VANISHING * size) & exact
    for k in range(least):
        out[:, k : k + windows] |= stuck
    return out


def _vanishing_bases(values: np.ndarray, there: np.ndarray, least: int) -> np.ndarray:
    """Bases with at least ``least`` recorded samples over all of which the innovations vanish: (rows, bases).

    Recorded samples of a base stand side by side, so their innovations are the steps between neighbours.
    """
    usable = there & np.isfinite(values)
    pair = usable[:, :, 1:] & usable[:, :, :-1]
    innovation = np.where(pair, np.subtract(values[:, :, 1:], values[:, :, :-1], where=pair, out=np.zeros(pair.shape)), 0.0)
    size = np.where(usable, values, 0.0)
    small = (innovation**2).sum(axis=2) <= VANISHING * (size**2).sum(axis=2)
    whole = (there.sum(axis=2) >= least) & (usable.sum(axis=2) == there.sum(axis=2)) & (pair.sum(axis=2) == np.maximum(there.sum(axis=2) - 1, 0))
    return whole & small & (innovation == 0).all(axis=2)


def _row_median(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Median over the last axis of the values that are there; NaN if none is."""
    n = there.sum(axis=-1)
    ordered = np.sort(np.where(there, values, np.inf), axis=-1)
    low = np.take_along_axis(ordered, np.maximum(n - 1, 0)[..., None] // 2, -1)[..., 0]
    high = np.take_along_axis(ordered, np.minimum(n // 2, ordered.shape[-1] - 1)[..., None], -1)[..., 0]
    return np.where(n > 0, (low + high) / 2, np.nan)


def _parts(batch: pa.RecordBatch, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose padded arrays stay small, even if single rows are very long."""
    length = lambda c: pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    raw = batch.column("raw_signals")
    places = pc.fill_null(pc.list_value_length(raw.flatten()), 0).to_numpy(zero_copy_only=False)
    outer = length("raw_signals").astype(np.int64)
    ends = np.cumsum(outer)
    deepest = np.array([places[e - o : e].max(initial=1) for o, e in zip(outer, ends)]) if len(set(places.tolist())) > 1 else np.full(len(outer), places[0] if len(places) else 1)
    size = np.maximum.reduce([outer * deepest, length("signal_means"), length("signal_stds")])
    kind = np.frexp(np.maximum(size, 1).astype(float))[1]
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        step = max(1, most >> int(k))
        for i in range(0, len(rows), step):
            yield batch if len(rows) == batch.num_rows <= step else batch.take(pa.array(rows[i : i + step]))


def _plausible(batch: pa.RecordBatch, min_run: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each field, the values that tell a source's normal behaviour (for raw signals one median per base), and their usual step.

    A step goes from one plausible value to the next base's; in raw signals from each recorded sample of a base to the next one of that
    base, wherever in the base they stand. A row gives the median size of its steps, which a few spikes do not move.
    """
    means, m = _matrix(batch.column("signal_means"))
    stds, s = _matrix(batch.column("signal_stds"))
    raw, r = _samples(batch.column("raw_signals"), batch.column("signal_lens"))
    good = r & np.isfinite(raw)
    level = _row_median(raw, good) if raw.size else np.full(raw.shape[:2], np.nan)
    stuck = _vanishing_bases(raw, r, min_run)
    fields = [
        (means, m & np.isfinite(means) & ~_vanishing(means, m, min_run)),
        (stds, s & np.isfinite(stds) & ~(stds < 0) & ~_vanishing(stds, s, min_run)),
        (level, np.isfinite(level) & ~stuck),
    ]
    steps = []
    for values, ok in fields[:2]:
        both = ok[:, 1:] & ok[:, :-1]
        steps.append((np.subtract(values[:, 1:], values[:, :-1], where=both, out=np.zeros(both.shape)), both))
    both = good[:, :, 1:] & good[:, :, :-1] & ~stuck[:, :, None]
    inside = np.subtract(raw[:, :, 1:], raw[:, :, :-1], where=both, out=np.zeros(both.shape))
    pairs = (len(raw), both.shape[1] * both.shape[2])
    steps.append((inside.reshape(pairs), both.reshape(pairs)))
    usual = [_row_median(np.abs(step), both)[:, None] if step.shape[1] else np.full((len(raw), 1), np.nan) for step, both in steps]
    return fields + [(x, np.isfinite(x)) for x in usual]


def source_behaviour(rows: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Centre, scale and noise share of each field of each source: ``_source, c0, s0, n0, c1, s1, n1, c2, s2, n2``.

    Quartiles of all plausible values from mergeable sketches (rank error 1/4000), and the mean of the rows' usual steps, so a source may hold any share of the rows.
    For a level that reverts by ``REVERSION`` a step's variance is twice what neighbours do not share, so it tells the level's
    share of the variance and with it the noise's.
    """

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                columns: list[pa.Array] = [batch.column("_source")]
                for value, good in _plausible(batch, min_run):
                    ends = np.concatenate([[0], np.cumsum(good.sum(axis=1))]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(value[good])))
                yield pa.RecordBatch.from_arrays(columns, names=["_source", *[f"v{i}" for i in range(6)]])

    lists = rows.where("_source is not null").select("_source", *FIELDS, "signal_lens").mapInArrow(values, "_source string, " + ", ".join(f"v{i} array<double>" for i in range(6)))
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"v{i}").alias("v")) for i in range(6)])).alias("x")
    single = lists.select("_source", named).select("_source", "x.f", F.explode("x.v").alias("v"))
    quartiles = single.groupBy("_source").agg(*[F.percentile_approx(F.when(F.col("f") == i, F.col("v")), [0.25, 0.5, 0.75], 4000).alias(f"q{i}") for i in range(3)], *[F.avg(F.when(F.col("f") == i + 3, F.col("v"))).alias(f"d{i}") for i in range(3)])
    out = [F.col("_source")]
    for i in range(3):
        scale = (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / QUARTILE_TO_SIGMA
        step = F.col(f"d{i}") * (2 / QUARTILE_TO_SIGMA)
        shared = 1 - F.try_divide(step * step, 2 * scale * scale)  # correlation of neighbours
        noise = F.coalesce(F.greatest(F.lit(LEAST_NOISE), F.least(F.lit(MOST_NOISE), 1 - shared / REVERSION)), F.lit(UNKNOWN_NOISE))
        out += [F.col(f"q{i}")[1].alias(f"c{i}"), scale.alias(f"s{i}"), noise.alias(f"n{i}")]
    return quartiles.select(*out)


def kalman_spikes(values: np.ndarray, usable: np.ndarray, centre: np.ndarray, scale: np.ndarray, noise: np.ndarray | float = UNKNOWN_NOISE, limit: float = INNOVATION_LIMIT) -> np.ndarray:
    """Spikes among values (series, steps): standardised innovations beyond the limit.

    Runs one filter per series, all series at once; ``noise`` is the noise's share of the variance. Flagged or unusable values
    give no update. A series whose scale is zero or unknown has none.
    """
    known = np.isfinite(centre) & (scale > 0)
    unit = np.where(known, scale, 1.0)
    u = np.ascontiguousarray(((values - np.where(known, centre, 0.0)[:, None]) / unit[:, None]).T)
    ok = np.ascontiguousarray((usable & known[:, None]).T)
    out = np.zeros(u.shape, bool)
    noise = np.nan_to_num(np.broadcast_to(np.asarray(noise, float), u.shape[1:]), nan=UNKNOWN_NOISE)
    stationary = 1 - noise
    level, spread = np.zeros(u.shape[1]), stationary.copy()
    for t in range(u.shape[0]):
        level *= REVERSION
        spread *= REVERSION**2
        spread += (1 - REVERSION**2) * stationary
        total = spread + noise
        innovation = np.where(ok[t], u[t], 0.0) - level
        flag = ok[t] & (innovation * innovation > limit * limit * total)
        out[t] = flag
        gain = np.where(ok[t] & ~flag, spread / total, 0.0)
        level += gain * innovation
        spread *= 1 - gain
    return out.T


def flag_implausible(features: DataFrame, row_id: str = "row_id", source: str = "readname", limit: float = INNOVATION_LIMIT, min_run: int = MIN_RUN) -> DataFrame:
    """``row_id, field_name, base_idx, reason``: each damaged base of each field, once per reason that holds.

    Rows without a source are not judged, nor are places outside the recorded samples, null lists and null
    elements. Lists may have any length. A source none of whose values vary gets no spikes. Repeated rows count each;
    other columns of the input are ignored, whatever their names.
    """
    rows = features.select(F.col(row_id).alias("_row"), read_key(F.col(source)).alias("_source"), *FIELDS, "signal_lens").where("_source is not null")
    behaviour = source_behaviour(rows, min_run)
    joined = split_join(rows, behaviour, "_source", "left")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                yield _judged(batch, limit, min_run)

    flags = joined.select("_row", *FIELDS, "signal_lens", *[f"{k}{i}" for i in range(3) for k in "csn"]).mapInArrow(judge, "_row bigint, field int, base_idx int, reason int")
    names, reasons = F.array(*[F.lit(f) for f in FIELDS]), F.array(F.lit("impossible"), F.lit("stuck"), F.lit("spike"))
    return flags.select(F.col("_row").alias("row_id"), names[F.col("field")].alias("field_name"), "base_idx", reasons[F.col("reason")].alias("reason"))


def _judged(batch: pa.RecordBatch, limit: float, min_run: int) -> pa.RecordBatch:
    row = batch.column("_row").to_numpy(zero_copy_only=False)
    behaviour = lambda f: [batch.column(f"{k}{f}").to_numpy(zero_copy_only=False).astype(float) for k in "csn"]
    found: list[tuple[int, int, np.ndarray]] = []
    for f in (0, 1):
        values, there = _matrix(batch.column(FIELDS[f]))
        impossible = there & (~np.isfinite(values) | ((values < 0) if f else False))
        found += [(f, 0, impossible), (f, 1, _vanishing(values, there, min_run)), (f, 2, kalman_spikes(values, there & ~impossible, *behaviour(f), limit))]
    raw, there = _samples(batch.column("raw_signals"), batch.column("signal_lens"))
    impossible = there & ~np.isfinite(raw)
    n, width, depth = raw.shape
    spikes = kalman_spikes(raw.reshape(n, width * depth), (there & ~impossible).reshape(n, width * depth), *behaviour(2), limit)
    found += [(2, 0, impossible.any(axis=2)), (2, 1, _vanishing_bases(raw, there, min_run)), (2, 2, spikes.reshape(n, width, depth).any(axis=2))]
    out: list[list[np.ndarray]] = [[], [], [], []]
    for f, reason, flags in found:
        i, base = np.nonzero(flags)
        for column, values in zip(out, (row[i], np.full(len(i), f), base, np.full(len(i), reason))):
            column.append(values)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k.to_pandas_dtype())) for c, k in zip(out, kinds)], names=["_row", "field", "base_idx", "reason"])


def implausible_bases(features: DataFrame) -> DataFrame:
    """``row_id, field_name, base_idx``: each damaged base of a field, once."""
    return flag_implausible(features).select("row_id", "field_name", "base_idx").distinct()
