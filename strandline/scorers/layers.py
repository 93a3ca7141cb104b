"""Neural layers as NumPy functions over a batch of rows; weights come as dictionaries of arrays."""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    """Softmax; a slice of nothing but -inf gives zeros."""
    top = x.max(axis=axis, keepdims=True)
    e = np.exp(x - np.where(np.isfinite(top), top, 0.0))
    total = e.sum(axis=axis, keepdims=True)
    return np.divide(e, total, out=np.zeros_like(e), where=total > 0)


def single(w: Weights) -> Weights:
    """Weights as 32-bit floats, the precision that the models are made for; those that are so already stay as they are."""
    return {k: v.astype(np.float32, copy=False) for k, v in w.items()}


def product(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The last axis of ``x`` times a matrix, as one product of matrices whatever axes stand before it."""
    return (np.ascontiguousarray(x).reshape(-1, x.shape[-1]) @ matrix).reshape(*x.shape[:-1], matrix.shape[1])


def linear(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    out = product(x, w[f"{name}.w"])
    out += w[f"{name}.b"]
    return out


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def gelu(x: np.ndarray) -> np.ndarray:
    """The tanh form of GELU."""
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def gru(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """States (rows, steps, width) of a gated recurrent layer that starts at zero; gates in the order reset, update, new."""
    wide = w[f"{name}.u"].shape[0]
    inputs = x @ w[f"{name}.w"] + w[f"{name}.b"]
    h, out = np.zeros((len(x), wide)), np.empty((*x.shape[:2], wide))
    for t in range(x.shape[1]):
        own = h @ w[f"{name}.u"] + w[f"{name}.c"]
        reset, update = np.split(sigmoid(inputs[:, t, : 2 * wide] + own[:, : 2 * wide]), 2, axis=1)
        new = np.tanh(inputs[:, t, 2 * wide :] + reset * own[:, 2 * wide :])
        h = (1 - update) * new + update * h
        out[:, t] = h
    return out


def lstm(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """States of a long short-term memory layer that starts at zero; gates in the order input, forget, cell, output.

    A sigmoid is half a tangent of half its argument, so one call does all gates of a step. Numbers keep the kind of ``x``.
    """
    wide = w[f"{name}.u"].shape[0]
    inputs = product(x, w[f"{name}.w"])
    inputs += w[f"{name}.b"] + w[f"{name}.c"]
    half = np.full(4 * wide, 0.5, x.dtype)
    half[2 * wide : 3 * wide] = 1
    h, c, out = np.zeros((len(x), wide), x.dtype), np.zeros((len(x), wide), x.dtype), np.empty((*x.shape[:2], wide), x.dtype)
    for t in range(x.shape[1]):
        gates = h @ w[f"{name}.u"]
        gates += inputs[:, t]
        gates *= half
        np.tanh(gates, out=gates)
        i, f, g, o = np.split(gates, 4, axis=1)
        for gate in (i, f, o):
            gate += 1
            gate *= 0.5
        c *= f
        c += i * g
        h = np.tanh(c)
        h *= o
        out[:, t] = h
    return out


def both_ways(layer, x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """A recurrent layer read forwards and backwards, states side by side at each step."""
    return np.concatenate([layer(x, w, f"{name}.fwd"), layer(x[:, ::-1], w, f"{name}.bwd")[:, ::-1]], axis=2)


def ends(states: np.ndarray) -> np.ndarray:
    """The last forward and the last backward state."""
    half = states.shape[2] // 2
    return np.concatenate([states[:, -1, :half], states[:, 0, half:]], axis=1)


def attend(states: np.ndarray, query: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """Additive attention: the states' mean, weighted by how well each goes with the query."""
    scores = np.tanh((query @ w[f"{name}.query"])[:, None] + states @ w[f"{name}.key"]) @ w[f"{name}.v"]
    return (softmax(scores, axis=1)[..., None] * states).sum(axis=1)


def _uniform(rng: np.random.Generator, shape: tuple[int, ...], width: int) -> np.ndarray:
    return rng.uniform(-1, 1, shape) / np.sqrt(width)


def make_linear(w: Weights, rng: np.random.Generator, name: str, size: int, out: int) -> None:
    w[f"{name}.w"], w[f"{name}.b"] = _uniform(rng, (size, out), size), _uniform(rng, (out,), size)


def make_recurrent(w: Weights, rng: np.random.Generator, name: str, size: int, wide: int, gates: int) -> None:
    for way in ("fwd", "bwd"):
        w[f"{name}.{way}.w"], w[f"{name}.{way}.u"] = _uniform(rng, (size, gates * wide), wide), _uniform(rng, (wide, gates * wide), wide)
        w[f"{name}.{way}.b"], w[f"{name}.{way}.c"] = _uniform(rng, (gates * wide,), wide), _uniform(rng, (gates * wide,), wide)
