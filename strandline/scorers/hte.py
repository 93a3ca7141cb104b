"""The temporal encoder over all samples of a site's bases, as NumPy functions.

Five channels (the sample and four numbers of its base's letter) run along the samples. Each mixing layer puts a class
token before every channel, attends over time within the channel and passes a two-layer net; between layers pairs of
steps are merged. The class tokens' maximum over channels and the proximity tag go to the head.
"""

from __future__ import annotations

import numpy as np

from strandline.scorers.layers import Weights, linear, make_linear, product, single, softmax

LETTERS, CHANNELS, MERGES, DEPTH, HIDDEN = 16, 5, 4, 2, 4
THETA = 10_000.0
#: Rows that are computed together (one, so that a score does not depend on the rows beside it), steps that pass the two-layer net or
#: attention at a time (the latter as whole channels), and numbers that stay in the cache between the operations on them.
ROWS, STEPS, NUMBERS = 1, 256, 1 << 15
#: Fixed values, fitted: twice the share of a normal distribution beyond a size is this polynomial of it to the power of -16, which takes
#: no exponential. The size times the share is off by less than 6e-8.
BEYOND = (1.0, 0.04986909678, 0.02112751482, 0.003313302220, -5.150190621e-06, 7.478644669e-05, -2.073582084e-06, 8.168978933e-07)


def _gelu(x: np.ndarray) -> np.ndarray:
    """``x`` times the share of a normal distribution below it, written over ``x``.

    By a polynomial for the share beyond ``|x|``, some numbers at a time, step by step in two arrays that stay. Where its power is too
    large for a float, the share is 0.
    """
    factors = [x.dtype.type(2 ** (1 / 16) * f) for f in BEYOND]
    flat = x.reshape(-1)
    sizes, polys = np.empty((2, min(NUMBERS, len(flat))), x.dtype)
    with np.errstate(over="ignore"):
        for at in range(0, len(flat), NUMBERS):
            part = flat[at : at + NUMBERS]
            size, poly = sizes[: len(part)], polys[: len(part)]
            np.abs(part, out=size)
            np.multiply(size, factors[-1], out=poly)
            for factor in factors[-2:0:-1]:
                poly += factor
                poly *= size
            poly += factors[0]
            for _ in range(4):
                np.multiply(poly, poly, out=poly)
            size /= poly
            np.maximum(part, 0, out=part)
            part -= size
    return x


def weights(seed: int = 0, wide: int = 128) -> Weights:
    """Seeded weights; ``wide`` 128 is the full size."""
    rng, w = np.random.default_rng(seed), {}
    w["letters"], w["channels"], w["class"] = rng.normal(0, 1, (LETTERS, 4)), rng.normal(0, 0.1, (CHANNELS, wide)), rng.random((CHANNELS, wide))
    for i in range(MERGES + 1):
        for k in range(DEPTH):
            for part in "qkv":
                make_linear(w, rng, f"mix{i}.att{k}.{part}", wide, wide)
            w[f"mix{i}.att{k}.gain"], w[f"mix{i}.att{k}.scale"] = np.ones(wide), np.full(wide, 1e-5)
        make_linear(w, rng, f"mix{i}.up", wide, HIDDEN * wide)
        make_linear(w, rng, f"mix{i}.down", HIDDEN * wide, wide)
        w[f"mix{i}.gain"], w[f"mix{i}.shift"], w[f"mix{i}.scale"] = np.ones(wide), np.zeros(wide), np.full(wide, 1e-5)
        if i:
            make_linear(w, rng, f"merge{i}", 2 * wide, wide)
    make_linear(w, rng, "head", wide + 1, HIDDEN * wide)
    make_linear(w, rng, "out", HIDDEN * wide, 2)
    return w


def _angles(places: np.ndarray, wide: int) -> np.ndarray:
    return places[:, None] * THETA ** (-np.arange(0, wide, 2) / wide)


def folded(w: Weights) -> Weights:
    """Weights as 32-bit floats with what follows or precedes each product taken into it: gains, shifts, scales, the scores' divisor and the mean's.

    Queries, keys and values come from one product.
    """
    wide = w["channels"].shape[1]
    out = {k: v for k, v in w.items() if not k.startswith("mix")}
    for i in range(MERGES + 1):
        for k in range(DEPTH):
            name = f"mix{i}.att{k}"
            parts = [(w[f"{name}.{part}.w"], w[f"{name}.{part}.b"]) for part in "qkv"]
            (qw, qb), (kw, kb), (vw, vb) = parts
            scale = w[f"{name}.scale"]
            matrix = np.concatenate([qw / np.sqrt(wide), kw, vw * scale], axis=1)
            out[f"{name}.w"], out[f"{name}.b"] = w[f"{name}.gain"][:, None] * matrix, np.concatenate([qb / np.sqrt(wide), kb, vb * scale])
        up, down, scale = f"mix{i}.up", f"mix{i}.down", w[f"mix{i}.scale"]
        out[f"{up}.w"], out[f"{up}.b"] = w[f"mix{i}.gain"][:, None] * w[f"{up}.w"], w[f"mix{i}.shift"] @ w[f"{up}.w"] + w[f"{up}.b"]
        out[f"{down}.w"], out[f"{down}.b"] = w[f"{down}.w"] * scale, w[f"{down}.b"] * scale
        if i:
            out[f"merge{i}.w"] = w[f"merge{i}.w"] * np.repeat([1, 0.5], wide)[:, None]
    return single(out)


def _turned(qkv: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Queries and keys, in place: each pair of their numbers, taken as a complex one, turned by the angle of its place."""
    half = turns.shape[-1]
    pairs = qkv[..., : 4 * half].view(np.complex64)
    pairs[..., :half] *= turns
    pairs[..., half:] *= turns
    return qkv


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("...d,...d->...", x, x)) * x.dtype.type(1 / np.sqrt(x.shape[-1])) + x.dtype.type(1e-8)


def _asked(x: np.ndarray, turns: np.ndarray, w: Weights, name: str) -> np.ndarray:
    """Queries, keys and values of steps."""
    return _turned(linear(x * (1 / _lengths(x))[..., None], w, name), turns)


def _attend(x: np.ndarray, qkv: np.ndarray, ends: np.ndarray, tokens: bool = False) -> None:
    """Adds to ``x`` (channels, steps of all rows, wide) what each step, or only the class tokens, takes from those of its row and channel."""
    wide = x.shape[-1]
    start = 0
    for end in ends:
        asking = slice(start, start + 1 if tokens else end)
        scores = qkv[:, asking, :wide] @ qkv[:, start:end, wide : 2 * wide].swapaxes(1, 2)
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        taken = scores @ qkv[:, start:end, 2 * wide :]
        taken /= scores.sum(axis=2, keepdims=True)
        x[:, asking] += taken
        start = end


def _fed(x: np.ndarray, w: Weights, name: str) -> None:
    """Adds to ``x`` the two-layer net of each step; some steps at a time, so that what lies between the layers stays in the cache."""
    flat = x.reshape(-1, x.shape[-1])
    for at in range(0, len(flat), STEPS):
        part = flat[at : at + STEPS]
        centred = part - part.mean(axis=1, keepdims=True)
        spread = np.einsum("td,td->t", centred, centred) * x.dtype.type(1 / x.shape[-1]) + x.dtype.type(1e-5)
        centred *= (1 / np.sqrt(spread))[:, None]
        part += linear(_gelu(linear(centred, w, f"{name}.up")), w, f"{name}.down")


def _merged(x: np.ndarray, row: np.ndarray, at: np.ndarray, w: Weights, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps whose numbers share a half merged: their maximum and mean. Class tokens (number -1) stay."""
    to, wide = at // 2, x.shape[-1]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (to[1:] != to[:-1])]))
    left, right = x[:, first], x[:, np.append(first[1:], len(at)) - 1]  # the same step, if it is alone
    both = np.empty((len(x), len(first), 2 * wide), x.dtype)
    np.maximum(left, right, out=both[..., :wide])
    np.add(left, right, out=both[..., wide:])  # half of it in the weights
    out = linear(both, w, name)
    row, at = row[first], to[first]
    out[:, at < 0] = left[:, at < 0]
    return out, row, at


def _started(w: Weights, places: int, letters: np.ndarray) -> Weights:
    """Weights with tables of all that a step can be before the first attention, and of what it asks there, so that no row computes it.

    The last line of each table is the class token. In the letters' channels a line for each of ``letters`` and place has the step and its
    queries, keys and values. In the samples' channel these are (a sample times ``rise``, plus ``base``) by the step's length, plus ``rest``.
    Each letter is a product of its own, so that no line depends on the other letters.
    """
    wide, name = w["channels"].shape[1], "mix0.att0"
    angles = _angles(np.arange(places + 1), wide)
    out = w | {"turns": np.exp(1j * angles).astype(np.complex64)}
    waves = np.stack([np.sin(angles), np.cos(angles)], axis=2).reshape(places + 1, wide).astype(np.float32)[:-1]
    later, still = out["turns"][1:], out["turns"][:1]
    token = w["class"][:, None]
    for c in range(1, CHANNELS):
        parts = [w["letters"][letter, c - 1] * w["channels"][c] + waves for letter in letters]
        out[f"start{c}"] = np.concatenate([*parts, token[c]])
        out[f"start{c}.asked"] = np.concatenate([*(_asked(x, later, w, name) for x in parts), _asked(token[c], still, w, name)])
    turns = np.concatenate([later, still])
    rise = np.concatenate([np.repeat(w["channels"][:1], places, axis=0), np.zeros_like(token[0])])
    out["start0"] = np.concatenate([waves, token[0]])
    out["start0.rise"], out["start0.base"] = [_turned(product(x, w[f"{name}.w"]), turns) for x in (rise, out["start0"])]
    out["start0.rest"] = _turned(np.repeat(w[f"{name}.b"][None], places + 1, axis=0), turns)
    return out


def _first(samples: np.ndarray, place: np.ndarray, line: np.ndarray, ends: np.ndarray, w: Weights) -> np.ndarray:
    """Steps (channels, steps of all rows, wide) after the first attention; one channel at a time, so that it stays in the cache."""
    x = np.empty((CHANNELS, len(place), w["channels"].shape[1]), np.float32)
    for c in range(CHANNELS):
        if c:
            np.take(w[f"start{c}"], line, axis=0, out=x[c], mode="clip")
            asked = w[f"start{c}.asked"][line]
        else:
            x[c] = samples[:, None] * w["channels"][c]
            x[c] += w["start0"][place]
            asked = w["start0.rise"][place]
            asked *= samples[:, None]
            asked += w["start0.base"][place]
            asked *= (1 / _lengths(x[c]))[:, None]
            asked += w["start0.rest"][place]
        _attend(x[c : c + 1], asked[None], ends)
    return x


def _strongest(w: Weights, signals: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The class tokens' maximum over channels, (rows, wide). ``lines`` (rows, bases): each base's letter by its place in the tables of :func:`_started`."""
    n, bases, places_per_base = signals.shape
    flat = signals.reshape(n, -1)
    places = flat.shape[1]
    row, at = np.nonzero(np.concatenate([np.ones((n, 1), bool), ~np.isnan(flat)], axis=1))
    at -= 1
    token = at < 0
    samples = np.where(token, 0, flat[row, at]).astype(np.float32)
    line = np.where(token, len(w["start1"]) - 1, lines[row, at // places_per_base] * places + at)
    ends = np.searchsorted(row, np.arange(n), side="right")
    x, span = _first(samples, np.where(token, places, at), line, ends, w), 1
    for i in range(MERGES + 1):
        if i:
            span *= 2
            x, row, at = _merged(x, row, at, w, f"merge{i}")
            ends = np.searchsorted(row, np.arange(n), side="right")
        turns, last, some = w["turns"][np.where(at < 0, 0, at * span + 1)], i == MERGES, max(1, STEPS // len(at))
        for k in range(0 if i else 1, DEPTH):
            for c in range(0, CHANNELS, some):
                part = x[c : c + some]
                _attend(part, _asked(part, turns, w, f"mix{i}.att{k}"), ends, last and k == DEPTH - 1)
        if last:  # nothing but the class tokens is used after it
            x = np.ascontiguousarray(x[:, at < 0])
        _fed(x, w, f"mix{i}")
    return x.max(axis=0)


def probabilities(w: Weights, signals: np.ndarray, codes: np.ndarray, tags: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Probabilities (rows, 2) from samples (rows, bases, places; NaN where there is none), letter codes (rows, bases) and tags (rows).

    A step without a sample neither asks, answers nor counts in a merge, so only the recorded ones are computed: those of a few rows
    stand one behind another, each row's class token before them. The head takes 64-bit floats.
    """
    if not len(signals):
        return np.empty((0, 2))
    letters, lines = np.unique(np.clip(codes, 0, LETTERS - 1), return_inverse=True)
    small, lines = _started(folded(w), signals.shape[1] * signals.shape[2], letters), lines.reshape(codes.shape)
    parts = [_strongest(small, signals[i : i + rows], lines[i : i + rows]) for i in range(0, len(signals), rows)]
    best = np.concatenate([np.concatenate(parts).astype(float), tags[:, None]], axis=1)
    return softmax(linear(_gelu(linear(best, w, "head")), w, "out"))
