import math

import numpy as np
import pytest

from strandline.operators.spikes import flag_implausible, implausible_bases, kalman_spikes, source_behaviour

SCHEMA = "row_id bigint, readname string, signal_means array<double>, signal_stds array<double>, signal_lens array<int>, raw_signals array<array<double>>, _source string, c0 int"


def make(rng, i, name, level, noise):
    means = rng.normal(level, noise, 21).round(4)
    lens = rng.integers(1, 20, 21)
    raw = np.zeros((21, 15))
    for b, n in enumerate(np.minimum(lens, 15)):
        at = (15 - n) // 2
        raw[b, at : at + n] = (means[b] + rng.normal(0, noise / 8, n)).round(4)
    stds = rng.uniform(0.1, 0.3, 21).round(4)
    return [i, name, means.tolist(), stds.tolist(), lens.tolist(), raw.tolist(), "x", 1]


def brute(rows, limit=8.0):
    found = set()
    by = {}
    for r in rows:
        name = (r[1] or "").strip().lstrip("@").lower().split()
        if name:
            by.setdefault(name[0], []).append(r)
    for own in by.values():
        for f, field in ((2, "signal_means"), (3, "signal_stds"), (5, "raw_signals")):
            cells = []
            for r in own:
                for b in range(21):
                    if f == 5:
                        n = min(r[4][b], 15)
                        values = r[5][b][(15 - n) // 2 : (15 - n) // 2 + n]
                    else:
                        values = [r[f][b]]
                    cells.append((r, b, [v for v in values if v is not None]))
            good = [v for _, _, vs in cells for v in vs if math.isfinite(v) and not (f == 3 and v < 0)]
            centre = np.median(good)
            scale = 1.4826 * np.median(np.abs(np.array(good) - centre))
            for r, b, vs in cells:
                if any(not math.isfinite(v) or (f == 3 and v < 0) or abs(v - centre) > limit * scale for v in vs):
                    found.add((r[0], field, b))
                if f == 5 and len(vs) >= 5 and len(set(vs)) == 1:
                    found.add((r[0], field, b))
            if f != 5:
                for r in own:
                    for a in range(17):
                        window = r[f][a : a + 5]
                        if len(set(window)) == 1 and None not in window:
                            found |= {(r[0], field, b) for b in range(a, a + 5)}
    return found


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [make(rng, i, ["@Read1", "read1 ch=3", " read2 ", "READ2"][i % 4], [1.0, 1.0, -0.5, -0.5][i % 4], [0.5, 0.5, 1.2, 1.2][i % 4]) for i in range(80)]
    out[3][2][7] = 40.0
    out[4][2][2:8] = [out[4][2][2]] * 6
    out[5][3][1] = -0.2
    out[6][3][4] = float("nan")
    out[7][5][0][7] = -60.0
    out[8][4][3] = 9
    out[8][5][3] = [0.0] * 3 + [0.25] * 9 + [0.0] * 3
    out[9][4][2] = 3
    out[9][5][2] = [99.0] * 6 + [0.1, 0.2, 0.3] + [99.0] * 6  # outside the recorded places
    out[10][2][5] = float("inf")
    out.append([*out[3]])
    out[-1][0] = 1000
    return out


def test_matches_brute_force(spark, rows):
    got = {tuple(r) for r in implausible_bases(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert {(3, "signal_means", 7), (1000, "signal_means", 7), (8, "raw_signals", 3)} <= got


def test_reasons(spark, rows):
    got = {(r.row_id, r.field_name, r.base_idx): r.reason for r in flag_implausible(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3, "signal_means", 7] == "spike" and got[4, "signal_means", 3] == "stuck" and got[5, "signal_stds", 1] == "impossible"


def test_nulls_empty_and_odd_shapes(spark, rows):
    odd = [
        [2000, None, *rows[3][2:]],
        [2001, " . ", *rows[3][2:]],
        [2002, "read1", None, None, None, None, None, None],
        [2003, "read1", [], [], [], [], None, None],
        [2004, "read1", [1.0, None, 99.0], [0.2], [None, 3, 1], [None, [None, 1.0, 1.1], [1.0]], None, None],
        [2005, "lonely", [1.0] * 30, [0.1, 0.2], [1], [[1.0, float("nan"), 2.0]], None, None],
    ]
    got = {tuple(r) for r in implausible_bases(spark.createDataFrame(rows + odd, SCHEMA)).collect() if r.row_id >= 2000}
    assert (2004, "signal_means", 2) in got and not any(r[0] in (2000, 2001, 2002, 2003) for r in got)
    assert {(2005, "signal_means", b) for b in range(30)} | {(2005, "raw_signals", 0)} <= got
    assert implausible_bases(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_withholds_flagged_updates():
    values = np.array([[0.0, 0.1, 50.0, 50.0, 0.1, -0.1]])
    flags = kalman_spikes(values, np.ones_like(values, bool), np.array([0.0]), np.array([1.0]))
    assert flags.tolist() == [[False, False, True, True, False, False]]
    assert not kalman_spikes(values, np.ones_like(values, bool), np.array([0.0]), np.array([0.0])).any()


def test_usual_step_from_all_neighbours(spark):
    """The raw signals' usual step comes from all neighbouring samples of a base, wherever they stand and however long its list is."""
    rng = np.random.default_rng(8)
    raws = []
    for i in range(40):
        depth = 15 if i % 2 else 5
        raw = np.repeat(rng.normal(0, 1, 21)[:, None], depth, axis=1) + rng.normal(0, 1.5, (21, depth))
        raw[:, depth // 2] = raw[:, depth // 2 - 1]  # the two middle samples are alike
        raws.append(raw)
    rows = [[i, "r", [0.0] * 21, [0.1] * 21, [r.shape[1]] * 21, r.tolist()] for i, r in enumerate(raws)]
    frame = spark.createDataFrame(rows, "row_id bigint, _source string, signal_means array<double>, signal_stds array<double>, signal_lens array<int>, raw_signals array<array<double>>")
    got = source_behaviour(frame).first()
    usual = np.mean([np.median(np.abs(np.diff(r, axis=1))) for r in raws]) * 2 / 1.349
    want = 1 - (1 - usual**2 / (2 * got["s2"] ** 2)) / 0.5
    assert 0.3 < want < 0.9 and got["n2"] == pytest.approx(want, rel=1e-9)
    single = spark.createDataFrame([[0, "r", [0.0], [0.1], [1], [[1.0]]], [1, "r", [0.0], [0.1], [1], [[2.0]]], [2, "r", [], [], [], []]], frame.schema)
    assert source_behaviour(single).first()["n2"] == 0.9  # no step is known: the most, as in the SQL
