import gzip
import math
import random
import struct
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays, cigar, modtags, seq, signal
from strandline.operators import calib, freq, training
from strandline.scorers import hte, layers, models
from strandline.sources import bam, text
from strandline.streaming.sites import call_stream, running_sites


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_sequence_functions(spark):
    row = one(
        spark, seq.motif_sites(F.lit("CCCC"), ["CC"]), seq.motif_sites(F.lit("ACGCG"), ["CG"]), seq.reverse_complement(F.lit("ACGN?")), seq.motif_sites(F.lit(""), ["CG"]), seq.centre(F.lit("ABCDEFGHIJK")), seq.codes(F.lit("ACGTx")),
        seq.motif_sites(F.lit("CG"), ["CG"], 1),
    )
    assert [list(row[0]), list(row[1]), row[2], list(row[3]), row[4], list(row[5]), list(row[6])] == [[0, 1, 2], [1, 3], "NNCGT", [], "DEFGH", [0, 1, 2, 3, -1], [1]]
    assert seq.expand("CHG") == ["CAG", "CCG", "CTG"]


def test_cigar_functions(spark):
    lift = lambda c, r: list(one(spark, cigar.query_to_reference(F.lit(c), F.lit(r)))[0])
    assert lift("2M1I2M", False) == [0, 1, -1, 2, 3, 4] and lift("2M1I2M", True) == [0, 1, -1, 2, 3, 4] and lift("1M1I3M", True) == [0, 1, 2, -1, 3, 4]
    assert list(one(spark, cigar.reference_to_query(F.lit("2M1D2M"), F.lit(False)))[0]) == [0, 1, 2, 2, 3]


def test_signal_functions(spark):
    array = lambda v: F.array(*[F.lit(float(x)) for x in v])
    rect = one(spark, signal.rectangle(F.array(array([7]), array([1, 2]), array(range(5))), 3))[0]
    assert np.isnan([rect[0][0], rect[0][2], rect[1][2]]).all() and rect[0][1] == 7 and rect[1][:2] == [1, 2] and rect[2] == [0, 2, 4]
    assert one(spark, signal.mad_scaled(array([1, 2, 4, 10])))[0][3] == pytest.approx((10 - 3) / 2.2239, rel=1e-3)
    assert one(spark, signal.standardised(array([5, 5])))[0] == [5, 5]


def test_tags(spark):
    places, probs = F.array(F.lit(2), F.lit(5)), F.array(F.lit(0.5), F.lit(1.0))
    row = one(spark, modtags.mm_tag(F.lit("ACCGTCG"), places), modtags.ml_tag(probs), modtags.called_places(F.lit("ACCGTCG"), F.lit("C+m?,1,0;")), modtags.mm_tag(F.lit("AC"), F.array(F.lit(0))))
    assert row[0] == "C+m?,1,0;" and list(row[1]) == [128, 255] and list(row[2]) == [2, 5] and row[3] is None


def test_histogram_and_percent(spark):
    rows = spark.createDataFrame([(0.15,), (1.0,), (0.0,)], "p double").agg(freq.histogram(F.col("p"))).first()[0]
    assert [i for i, n in enumerate(rows) if n] == [0, 2, 19]
    assert [one(spark, freq.percent(F.lit(x)))[0] for x in (1 / 8, 0.5, 0.005)] == [13, 50, 1]


def test_read_windows_over_blocks(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if i % 3 else f"r{i % 5}", f"c{i % 2}", rng.choice([7, 7, 7, rng.randrange(100_000)]), rng.random()) for i in range(900)]
    calls = spark.createDataFrame(rows, "row_id bigint, readname string, chrom string, pos bigint, prob_1 double")
    want = {}
    for key in {(r[1], r[2]) for r in rows}:
        own = sorted((r for r in rows if (r[1], r[2]) == key), key=lambda r: (r[3], r[0]))
        for i, r in enumerate(own):
            near = [own[j] if 0 <= j < len(own) else None for j in range(i - 5, i + 6)]
            want[r[0]] = ([x[4] if x else 0.0 for x in near], [float(abs(x[3] - r[3])) if x else 0.0 for x in near], [1.0 if x else 0.0 for x in near])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("2", "150"):  # blocks of some six calls are shorter than a window
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {r["row_id"]: (list(r["probs"]), list(r["offsets"]), list(r["valid"])) for r in calib.read_windows(calls).collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(calib.read_windows(calls.limit(1)).first()["valid"]) == 1 and calib.read_windows(calls.limit(0)).count() == 0


def test_anchor_windows_over_blocks(spark):
    rng = random.Random(10)
    spots = sorted({("a" if rng.random() < 0.8 else "b", rng.randrange(5000)) for _ in range(500)})
    sites = [(c, p, 1, [float(p)], rng.random() < (0.03 if p < 2500 else 0.6)) for c, p in spots]
    frame = spark.createDataFrame(sites, "chrom string, pos bigint, coverage bigint, hist array<double>, is_anchor boolean")
    want = set()
    for c, p, *_ in sites:
        anchors = [x[1] for x in sites if x[0] == c and x[4]]
        for k, near in enumerate(sorted((a for a in anchors if a < p), reverse=True)[:5], 1):
            want.add((c, p, -k, near))
        for k, near in enumerate(sorted(a for a in anchors if a > p)[:5], 1):
            want.add((c, p, k, near))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("2", "120"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = [(r["chrom"], r["pos"], r["slot"], r["near_pos"]) for r in freq.anchor_neighbours(frame).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_arrays_and_texts(spark):
    values = [((i * 7919) % 13) - 3 for i in range(40_000)]
    frame = spark.createDataFrame([(values,), ([],), ([5],)], "v array<bigint>")
    got = [list(r[0]) for r in frame.select(arrays.prefix_sums(F.col("v"))).collect()]
    assert got[0] == list(np.cumsum([0, *values])[:-1]) and got[1] == [] and got[2] == [0]
    text = "".join(random.Random(3).choice("ACGT") for _ in range(50_000))
    sites = [i for i in range(len(text) - 1) if text[i : i + 2] == "CG"]
    row = spark.createDataFrame([(text, sites)], "s string, p array<int>").select(
        seq.motif_sites(F.col("s"), ["CG"]), modtags.skips(F.col("s"), F.col("p")), modtags.called_places(F.col("s"), modtags.mm_tag(F.col("s"), F.col("p"))), seq.proximity(F.col("p")), seq.gc_shares(F.col("s"))
    ).first()
    assert list(row[0]) == sites and list(row[2]) == sites
    assert list(row[1]) == [text.count("C", (sites[i - 1] + 1) if i else 0, s) for i, s in enumerate(sites)]
    assert list(row[3]) == [int(any(0 < abs(s - t) <= 10 for t in sites[max(0, i - 1) : i + 2])) for i, s in enumerate(sites)]
    assert list(row[4]) == pytest.approx([sum(x in "GC" for x in text[max(0, s - 50) : s + 50]) / 100 for s in sites])
    steps = [(random.Random(i).randrange(1, 9), "MID"[i % 3]) for i in range(3000)]
    places, q, r = [], 0, 0
    for n, op in steps:
        for _ in range(n if op != "D" else 0):
            places.append(r if op == "M" else -1)
            r += op == "M"
        r += n if op == "D" else 0
    lifted = spark.createDataFrame([("".join(f"{n}{op}" for n, op in steps),)], "c string").select(cigar.query_to_reference(F.col("c"), F.lit(False))).first()[0]
    assert list(lifted) == [*places, r]


def test_text_round_trip(spark, tmp_path):
    calls = spark.createDataFrame([("chr1", 5, "+", None, "r", ".", 0.25, 0.75, 1, "ACGTA")], "chrom string, pos bigint, strand string, pos_in_strand bigint, readname string, read_loc string, prob_0 double, prob_1 double, called_label int, k_mer string")
    text.write_lines(text.call_lines(calls), str(tmp_path / "calls"), gzip=True)
    back = text.read_calls(spark, [str(tmp_path / "calls")]).collect()
    assert back[0]["prob_1"] == 0.75 and back[0]["pos_in_strand"] is None and back[0]["reject"] is None
    (tmp_path / "bad.tsv").write_text("chr1\t5\nchr1\tx\t+\t.\tr\t.\t0.1\t0.9\t1\tACGTA\n")
    assert sorted(r["reject"] for r in text.read_calls(spark, [str(tmp_path / "bad.tsv")]).collect()) == ["bad_value", "column_count"]
    with pytest.raises(ValueError):
        text.read_calls(spark, [str(tmp_path / "none")])
    (tmp_path / "x.fa").write_text(">c1 first\nacg\nT\n>c2\nGG\n")
    assert sorted(map(tuple, text.read_fasta(spark, [str(tmp_path / "x.fa")]).collect())) == [("c1", "ACGT", 4), ("c2", "GG", 2)]
    (tmp_path / "x.slow5").write_text("#slow5_version\t0.2.0\n@asic\t1\nr1\t0\t8192\t10\t1400\t4000\t3\t1,2,3\n")
    assert list(text.read_slow5(spark, [str(tmp_path / "x.slow5")]).first()["signal"]) == [1, 2, 3]


def bam_bytes():
    name, seq_bytes, n = b"r1\0", bytes([0x12, 0x48]), 4
    tags = b"mvBc" + struct.pack("<I3b", 3, 5, 1, 0) + b"tsi" + struct.pack("<i", 7) + b"NMC" + b"\x02" + b"piZp1\0"
    record = struct.pack("<iiBBHHHiiii", 0, 11, len(name), 60, 0, 1, 16, n, -1, -1, 0) + name + struct.pack("<I", n << 4) + seq_bytes + b"\x1e" * n + tags
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    return gzip.compress(head + record[:0]) + gzip.compress(struct.pack("<i", len(record)) + record)


def test_bam_source(spark, tmp_path):
    path = tmp_path / "x.bam"
    path.write_bytes(bam_bytes())
    spark.dataSource.register(bam.BamSource)
    row = spark.read.format("bam").option("paths", str(path)).load().first()
    assert (row["read_id"], row["parent_id"], row["flag"], row["ref_name"], row["ref_start"], row["cigar"], row["seq"], row["stride"], list(row["moves"]), row["ts"], row["nm"]) == ("r1", "p1", 16, "chr1", 11, "4M", "ACGT", 5, [1, 0], 7, 2)


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.tsv").write_text("".join(f"chr1\t{i % 4}\t+\t.\tr{i}\t.\t0.1\t0.9\t{(i + k) % 2}\tACGTA\n" for i in range(20)))
    query = running_sites(call_stream(spark, str(folder), 1)).writeStream.outputMode("complete").format("memory").queryName("sites").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.table("sites").collect()))
    assert [r[2] for r in got] == [15] * 4 and sum(r[3] for r in got) == 30


def test_scorers_are_deterministic_and_shaped():
    rng = np.random.default_rng(1)
    sites = models.score_sites(models.site_weights(), rng.random((5, 11, 20)), rng.random((5, 11)) * 100)
    calls = models.score_calls(models.calibrator_weights(), rng.random((5, 11)), rng.random((5, 11)) * 1e4, np.ones((5, 11)), rng.random((5, 3)))
    arrays = rng.integers(0, 4, (5, 21)), rng.random((5, 21)), rng.random((5, 21)), rng.integers(1, 9, (5, 21)), rng.random((5, 21, 15))
    full = models.score_features(models.caller_weights(wide=8), *arrays)
    assert sites.shape == (5,) and ((0 <= sites) & (sites <= 1)).all() and ((0 < calls) & (calls < 1)).all() and np.allclose(full.sum(1), 1)
    size = lambda w: sum(v.size for v in w.values())
    assert (size(models.site_weights()), size(models.calibrator_weights())) == (14_753, 15_649)
    assert np.array_equal(full, models.score_features(models.caller_weights(wide=8), *arrays))


def test_gru_by_hand():
    w = {"g.w": np.array([[0.0, 0.0, 1.0]]), "g.u": np.zeros((1, 3)), "g.b": np.zeros(3), "g.c": np.zeros(3)}
    states = layers.gru(np.ones((1, 2, 1)), w, "g")[0, :, 0]
    assert states[0] == pytest.approx(0.5 * np.tanh(1)) and states[1] == pytest.approx(0.75 * np.tanh(1))


def test_denoise_removes_flipped_labels(spark):
    rows = spark.createDataFrame([(i, (i % 2) ^ (i % 20 == 0), float(i % 2)) for i in range(200)], "row_id bigint, label int, x double")

    def scorer(train, test):
        return test.select("row_id", F.col("x").alias("prob"))

    kept = training.denoise(rows, scorer, rounds=2, iterations=3)
    assert kept.count() == 190 and kept.columns == rows.columns


def test_encoder_size_and_masking():
    assert sum(v.size for v in hte.weights().values()) == 1_358_914
    rng, w = np.random.default_rng(2), hte.weights(wide=8)
    signals = rng.random((3, 21, 15))
    signals[:, :, 10:] = np.nan
    codes, tags = rng.integers(0, 4, (3, 21)), np.array([0.0, 1.0, 1.0])
    p = hte.probabilities(w, signals, codes, tags)
    assert p.shape == (3, 2) and np.allclose(p.sum(1), 1) and np.allclose(p, hte.probabilities(w, signals, codes, tags, rows=1))
    signals[0] = np.nan
    assert np.isfinite(hte.probabilities(w, signals, codes, tags)).all()


def test_caller_memory_and_batches():
    """Memory of the recurrent caller does not grow with the batch, and a row's score does not depend on its batch."""
    rng, w, n = np.random.default_rng(3), models.caller_weights(wide=16), 3000
    arrays = rng.integers(0, 4, (n, 21)), rng.random((n, 21)), rng.random((n, 21)), rng.integers(1, 9, (n, 21)), rng.random((n, 21, 15))
    tracemalloc.start()
    whole = models.score_features(w, *arrays)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole.shape == (n, 2) and peak < 20e6
    cuts = [0, 1, 130, 2000, n]
    parts = [models.score_features(w, *[x[i:j] for x in arrays]) for i, j in zip(cuts, cuts[1:])]
    assert np.array_equal(whole, np.concatenate(parts)) and models.score_features(w, *[x[:0] for x in arrays]).shape == (0, 2)


def _encoder_rows(n):
    """Rows with 1 to 15 recorded samples a base, the first without any, the second with one."""
    rng = np.random.default_rng(5)
    signals, lens = rng.normal(-1, 1, (n, 21, 15)), rng.integers(1, 16, (n, 21, 1))
    first = (15 - lens) // 2
    signals[(np.arange(15) < first) | (np.arange(15) >= first + lens)] = np.nan
    signals[:2], signals[1, 3, 4] = np.nan, 1.0
    return signals, rng.integers(0, 4, (n, 21)), rng.integers(0, 2, n).astype(float)


def _encoder_by_hand(w, signal, codes, tag):
    """Probabilities of one row, step by step over all 315 places, hidden ones included."""
    wide = w["channels"].shape[1]
    erf = np.vectorize(math.erf)
    gelu = lambda x: x * (1 + erf(x / math.sqrt(2))) / 2
    lin = lambda x, name: x @ w[f"{name}.w"] + w[f"{name}.b"]
    rates = 10_000.0 ** (-np.arange(0, wide, 2) / wide)
    tokens = []
    for c in range(5):
        values = np.nan_to_num(signal.ravel()) if c == 0 else np.repeat(w["letters"][codes, c - 1], 15)
        there, places = ~np.isnan(signal.ravel()), np.arange(315)
        waves = np.empty((315, wide))
        waves[:, 0::2], waves[:, 1::2] = np.sin(places[:, None] * rates), np.cos(places[:, None] * rates)
        x, token = values[:, None] * w["channels"][c] + waves, w["class"][c]
        for i in range(5):
            if i:
                odd = len(x) % 2
                x, there, places = np.concatenate([x, x[len(x) - odd :]]), np.concatenate([there, np.zeros(odd, bool)]), np.concatenate([places, places[len(places) - odd :]])
                pairs = []
                for j in range(0, len(x), 2):
                    own = x[j : j + 2][there[j : j + 2]]
                    pairs.append(np.concatenate([own.max(axis=0), own.mean(axis=0)]) if len(own) else np.zeros(2 * wide))
                x, there, places = lin(np.array(pairs), f"merge{i}"), there.reshape(-1, 2).any(axis=1), places[::2]
            y, seen, turn = np.concatenate([token[None], x]), np.concatenate([[True], there]), np.exp(1j * np.concatenate([[0], places + 1])[:, None] * rates)
            for k in range(2):
                name = f"mix{i}.att{k}"
                normed = y / (np.linalg.norm(y, axis=1, keepdims=True) / math.sqrt(wide) + 1e-8) * w[f"{name}.gain"]
                q, key = ((lin(normed, f"{name}.{part}")[:, 0::2] + 1j * lin(normed, f"{name}.{part}")[:, 1::2]) * turn for part in "qk")
                e = np.exp((q @ key.conj().T).real / math.sqrt(wide)) * (seen[:, None] & seen)
                y = y + e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300) @ lin(normed, f"{name}.v") * w[f"{name}.scale"]
            normed = (y - y.mean(axis=1, keepdims=True)) / np.sqrt(y.var(axis=1, keepdims=True) + 1e-5) * w[f"mix{i}.gain"] + w[f"mix{i}.shift"]
            y = y + lin(gelu(lin(normed, f"mix{i}.up")), f"mix{i}.down") * w[f"mix{i}.scale"]
            token, x = y[0], y[1:]
        tokens.append(token)
    e = np.exp(lin(gelu(lin(np.append(np.max(tokens, axis=0), tag), "head")), "out"))
    return e / e.sum()


def test_encoder_by_hand():
    """Only recorded samples are computed, with the same result as over all places; scales far from zero show every part."""
    rng, w = np.random.default_rng(6), hte.weights(wide=16)
    for name in w:
        if name.endswith((".gain", ".scale", ".shift")):
            w[name] = rng.uniform(0.2, 0.8, w[name].shape)
    signals, codes, tags = _encoder_rows(9)
    p = hte.probabilities(w, signals, codes, tags)
    assert np.allclose(p, [_encoder_by_hand(w, *row) for row in zip(signals, codes, tags)], atol=2e-6)
    order = rng.permutation(9)
    assert np.array_equal(p[order], hte.probabilities(w, signals[order], codes[order], tags[order]))
    assert np.allclose(p, hte.probabilities(w, signals, codes, tags, rows=4), atol=1e-7)
    assert hte.probabilities(w, signals[:0], codes[:0], tags[:0]).shape == (0, 2)


def test_encoder_time_follows_recorded_samples():
    """Rows with one recorded sample a base take far less time than rows with all 15."""
    signals, codes, tags = _encoder_rows(24)
    full, thin = np.nan_to_num(signals), np.where(np.arange(15) == 7, np.nan_to_num(signals), np.nan)
    w, seconds = hte.weights(wide=32), []
    for x in (thin, full, thin, full):
        began = time.thread_time()
        hte.probabilities(w, x, codes, tags)
        seconds.append(time.thread_time() - began)
    assert seconds[2] < seconds[3] / 2


def test_encoder_products_of_a_row(monkeypatch):
    """A row takes no product before the first attention, and after the last one only those of its class tokens."""
    wide, plain, counted = 16, hte.linear, []
    rng, w = np.random.default_rng(7), hte.weights(wide=wide)
    monkeypatch.setattr(hte, "linear", lambda x, w, name: counted.append(x.size * w[f"{name}.w"].shape[1]) or plain(x, w, name))

    def products(n):
        counted.clear()
        hte.probabilities(w, rng.random((n, 21, 15)), np.zeros((n, 21), int), np.ones(n))
        return sum(counted)

    steps = [316, 159, 80, 41, 21]
    asked, fed, merged = 3 * (2 * sum(steps) - steps[0]), 8 * (sum(steps[:-1]) + 1), 2 * sum(steps[1:])
    head = (wide + 1) * 4 * wide + 4 * wide * 2
    assert products(3) - products(1) == 2 * (5 * wide * wide * (asked + fed + merged) + head)


def test_encoder_score_does_not_depend_on_letters_beside_it():
    """Tables of the first attention hold the letters of a batch; a row scores the same beside rows with others (but for the 64-bit head's last digit)."""
    rng, w = np.random.default_rng(8), hte.weights(wide=16)
    signals, codes, tags = _encoder_rows(6)
    codes[3:] = rng.integers(4, 20, codes[3:].shape)
    p = hte.probabilities(w, signals, codes, tags)
    assert np.allclose(p, np.concatenate([hte.probabilities(w, *(x[i : i + 1] for x in (signals, codes, tags))) for i in range(6)]), rtol=0, atol=1e-14)
    assert np.allclose(p[4], _encoder_by_hand(w, signals[4], np.minimum(codes[4], 15), tags[4]), atol=2e-6)


def test_encoder_gelu():
    x = np.append(np.linspace(-12, 12, 100_001), [-3e38, -1e4, 1e4, 3e38])
    wanted = [v * math.erfc(-v / math.sqrt(2)) / 2 for v in x]
    assert np.allclose(hte._gelu(x.copy()), wanted, rtol=0, atol=6e-8)
    assert np.allclose(hte._gelu(x.astype(np.float32)), wanted, rtol=1e-7, atol=4e-7)
