"""Scorers: site estimator, read calibrator and per-read caller.

A scorer is a function of a batch of arrays; :func:`score` runs it over Arrow batches of a DataFrame. There are no
published weights, so a scorer starts from seeded ones; trained weights are loaded from a NumPy archive by :func:`load_weights`.
Recurrent layers start at zero states, which makes every scorer deterministic.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandline.scorers.layers import Weights, attend, both_ways, ends, gru, linear, lstm, make_linear, make_recurrent, relu, sigmoid, single, softmax

os.environ.setdefault("OMP_NUM_THREADS", "1")

STATE, BINS, WIDTH = 32, 20, 11
#: Rows that the per-read caller takes at a time.
ROWS = 128


def _attention(w: Weights, rng: np.random.Generator, width: int) -> None:
    for part in ("query", "key"):
        w[f"att.{part}"] = rng.uniform(-1, 1, (width, STATE)) / np.sqrt(width)
    w["att.v"] = rng.uniform(-1, 1, STATE) / np.sqrt(STATE)


def site_weights(seed: int = 0) -> Weights:
    """Seeded weights of the site estimator."""
    rng, w = np.random.default_rng(seed), {}
    make_recurrent(w, rng, "rnn", BINS + 1, STATE, 3)
    _attention(w, rng, 2 * STATE)
    make_linear(w, rng, "out", 2 * STATE, 1)
    return w


def score_sites(w: Weights, hist: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Frequency of sites from their windows: histograms (rows, 11, 20) and distances (rows, 11)."""
    states = both_ways(gru, np.concatenate([hist, dist[..., None]], axis=2), w, "rnn")
    return np.round(np.clip(linear(attend(states, ends(states), w, "att"), w, "out")[:, 0], 0, 1), 6)


def calibrator_weights(seed: int = 0) -> Weights:
    """Seeded weights of the read calibrator."""
    rng, w = np.random.default_rng(seed), {}
    make_recurrent(w, rng, "rnn", 3, STATE, 3)
    _attention(w, rng, 2 * STATE)
    make_linear(w, rng, "read", 3, 2 * STATE)
    make_linear(w, rng, "hidden", 4 * STATE, STATE)
    make_linear(w, rng, "out", STATE, 1)
    return w


def score_calls(w: Weights, probs: np.ndarray, offsets: np.ndarray, valid: np.ndarray, read: np.ndarray) -> np.ndarray:
    """Calibrated probability of calls from their read windows (rows, 11) and read features (rows, 3)."""
    x = np.stack([probs, np.clip(offsets / 1000, 0, 10), valid], axis=2)
    states = both_ways(gru, x, w, "rnn")
    joined = np.concatenate([attend(states, ends(states), w, "att"), relu(linear(read, w, "read"))], axis=1)
    return sigmoid(linear(relu(linear(joined, w, "hidden")), w, "out")[:, 0])


def caller_weights(seed: int = 0, wide: int = 128, layers: int = 3) -> Weights:
    """Seeded weights of the per-read caller; ``wide`` 128 and 3 layers are the full size."""
    rng, w = np.random.default_rng(seed), {}
    w["letters"] = rng.normal(0, 1, (16, 4))
    make_recurrent(w, rng, "seq", 7, wide, 4)
    make_linear(w, rng, "seq.out", 2 * wide, wide)
    make_recurrent(w, rng, "sig", 15, wide, 4)
    make_linear(w, rng, "sig.out", 2 * wide, wide)
    for i in range(layers):
        make_recurrent(w, rng, f"both{i}", 2 * wide if i == 0 else 4 * wide, 2 * wide, 4)
    make_linear(w, rng, "hidden", 4 * wide, 2 * wide)
    make_linear(w, rng, "out", 2 * wide, 2)
    return w


def score_features(w: Weights, codes: np.ndarray, means: np.ndarray, stds: np.ndarray, lens: np.ndarray, signals: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Probabilities (rows, 2) from k-mer codes, base statistics (rows, 21) and samples (rows, 21, 15), all finite.

    A fixed number of rows at a time, so memory does not grow with the batch; the last ones are filled up with rows of zeros, so that
    products always have the same shape and a row's score does not depend on the rows beside it.
    """
    w, parts = single(w), []
    for at in range(0, len(codes), rows):
        cut = [x[at : at + rows] for x in (codes, means, stds, lens, signals)]
        n = len(cut[0])
        letters, *numbers = [np.concatenate([x, np.zeros((rows - n, *x.shape[1:]), x.dtype)]) if n < rows else x for x in cut]
        parts.append(_score_features(w, letters, *[x.astype(np.float32) for x in numbers])[:n])
    return np.concatenate(parts) if parts else np.empty((0, 2))


def _score_features(w: Weights, codes: np.ndarray, means: np.ndarray, stds: np.ndarray, lens: np.ndarray, signals: np.ndarray) -> np.ndarray:
    seq = np.concatenate([w["letters"][codes], means[..., None], stds[..., None], lens[..., None]], axis=2)
    a = relu(linear(both_ways(lstm, seq, w, "seq"), w, "seq.out"))
    b = relu(linear(both_ways(lstm, signals, w, "sig"), w, "sig.out"))
    states = np.concatenate([a, b], axis=2)
    i = 0
    while f"both{i}.fwd.w" in w:
        states, i = both_ways(lstm, states, w, f"both{i}"), i + 1
    return softmax(linear(relu(linear(ends(states), w, "hidden")), w, "out").astype(float))


def load_weights(path: str) -> Weights:
    """Weights of a NumPy archive; prefixes that training tools put before names are cut off."""
    with np.load(path) as archive:
        return {k.removeprefix("_orig_mod.").removeprefix("module."): archive[k] for k in archive.files}


def score(frame: DataFrame, weights: Weights, run: Callable[[Weights, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a scorer over the batches of a DataFrame. The weights are broadcast: a model, a few MB whatever the data."""
    shared = frame.sparkSession.sparkContext.broadcast(weights)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield run(shared.value, pdf)

    return frame.mapInPandas(batches, schema)


def stacked(column: pd.Series) -> np.ndarray:
    """A column of equally long arrays as one array."""
    return np.stack([np.stack(x) if len(x) and isinstance(x[0], np.ndarray) else x for x in column]).astype(float)
