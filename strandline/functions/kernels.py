"""Array kernels on Arrow batches: what column expressions could only do by walking a text once per site."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType


def _per_row(kind: DataType, one: Callable) -> Callable[..., Column]:
    """A column function from a function of one row's values; null if one of them is."""

    @pandas_udf(ArrayType(kind))
    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else one(a, b) for a, b in zip(first, second)])

    return run


def _letters(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("ascii", "replace"), np.uint8)


def gaps_between(letter: str) -> Callable[[Column, Column], Column]:
    """Of a sequence and sorted places: the letters of a kind between one place and the next; null if some place holds another letter."""

    def one(seq: str, places: np.ndarray) -> np.ndarray | None:
        hit, at = _letters(seq) == ord(letter), np.asarray(places, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= len(hit) or not hit[at].all()):
            return None
        return np.diff(np.cumsum(hit)[at], prepend=0).astype(np.int32) - 1 if len(at) else at.astype(np.int32)

    return _per_row(IntegerType(), one)


def places_after_gaps(letter: str) -> Callable[[Column, Column], Column]:
    """Of a sequence and gaps as text, separated by commas: the places that :func:`gaps_between` came from; null if the sequence has fewer letters of the kind."""

    def one(seq: str, gaps: str) -> np.ndarray | None:
        steps = np.array([int(x) for x in gaps.split(",") if x], np.int64)
        hits, at = np.flatnonzero(_letters(seq) == ord(letter)), np.cumsum(steps + 1) - 1
        return hits[at].astype(np.int32) if not len(at) or at[-1] < len(hits) else None

    return _per_row(IntegerType(), one)


def letters_around(motif: str, letters: str, reach: int) -> Callable[[Column], Column]:
    """Of a sequence: for each place of a motif the letters of some kinds from ``reach`` before it to ``reach`` behind it, out of 2 * reach."""
    wanted = np.frombuffer(letters.encode(), np.uint8)

    def one(seq: str) -> np.ndarray:
        text = _letters(seq)
        hit = np.ones(max(len(text) - len(motif) + 1, 0), bool)
        for i, letter in enumerate(motif):
            hit &= text[i : i + len(hit)] == ord(letter)
        at, before = np.flatnonzero(hit), np.concatenate([[0], np.cumsum(np.isin(text, wanted))])
        return (before[np.minimum(at + reach, len(text))] - before[np.maximum(at - reach, 0)]) / (2.0 * reach)

    @pandas_udf(ArrayType(DoubleType()))
    def run(seqs: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else one(s) for s in seqs])

    return run


def near_letter(letter: str, reach: int) -> Callable[[Column, Column], Column]:
    """Of a sequence and places: 1 if the letter stands at another place within ``reach``, else 0."""

    def one(seq: str, places: np.ndarray) -> np.ndarray:
        hit, at = _letters(seq) == ord(letter), np.asarray(places, np.int64)
        before = np.concatenate([[0], np.cumsum(hit)])
        return (before[np.minimum(at + reach + 1, len(hit))] - before[np.maximum(at - reach, 0)] > hit[at]).astype(np.int32)

    return _per_row(IntegerType(), one)
