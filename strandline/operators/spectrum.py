"""Spectra of signals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def spectrum(frame: DataFrame, key: str, signal: str) -> DataFrame:
    """``key, magnitude, phase``: the discrete Fourier transform of each array.

    Null and empty arrays have null spectra; null and NaN samples count as 0. Arrays of one length are transformed together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            flat = np.nan_to_num(batch.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
            ends = np.cumsum(lengths)
            size, angle = [None] * len(lengths), [None] * len(lengths)
            for n in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == n)
                parts = np.fft.fft(flat[(ends[rows] - n)[:, None] + np.arange(n)], axis=1)
                for i, p in zip(rows, parts):
                    size[i], angle[i] = np.abs(p), np.angle(p)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, kind), pa.array(angle, kind)], names=[key, "magnitude", "phase"])

    return frame.select(key, signal).mapInArrow(run, f"`{key}` {frame.schema[key].dataType.simpleString()}, magnitude array<double>, phase array<double>")
