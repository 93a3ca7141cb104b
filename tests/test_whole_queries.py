"""Queries that run with the whole of what their operators are for, against brute force on small tables."""

import random
from collections import Counter

from strandline.plans import pipelines
from strandline.queries import calls, scored, sequences


def test_anchors_from_coverage_four(spark, tmp_path):
    rng = random.Random(4)
    coverage = {(f"chr{rng.randrange(3)}", rng.randrange(200_000)): rng.randrange(1, 9) for _ in range(160)}
    sites = [site for site, n in coverage.items() for _ in range(n)]
    rows = [(i, chrom, pos, f"r{i % 7}", 1 - p, p, int(p > 0.5)) for i, (chrom, pos) in enumerate(sites) for p in [rng.randrange(101) / 100]]
    spark.createDataFrame(rows, "row_id bigint, chrom string, pos bigint, readname string, prob_0 double, prob_1 double, called_label int").write.parquet(f"{tmp_path}/calls.parquet")
    near, ranks, windows = set(), set(), set()
    for chrom, pos in coverage:
        anchors = sorted(p for (c, p), n in coverage.items() if c == chrom and n >= 4)
        before, after = [p for p in anchors if p < pos], [p for p in anchors if p > pos]
        on_chrom = [p for c, p in coverage if c == chrom]
        ranks.add((chrom, pos, len(before)))
        windows.add((chrom, pos, 5, 0))
        for k in range(1, 6):
            for slot, side, pad in ((-k, before[::-1], min(on_chrom) - 10_000), (k, after, max(on_chrom) + 10_000)):
                if len(side) >= k:
                    near.add((chrom, pos, slot, side[k - 1]))
                windows.add((chrom, pos, slot + 5, abs((side[k - 1] if len(side) >= k else pad) - pos)))
    got = lambda name: Counter(map(tuple, calls.QUERIES[name](spark, str(tmp_path)).collect()))
    assert near and got("anchor_neighbours_cov4") == Counter(near)
    assert got("anchor_rank_cov4") == Counter(ranks) and got("anchor_windows_cov4") == Counter(windows)
    marks = {(r["chrom"], r["pos"]): r["is_anchor"] for r in calls.site_histogram_norm_cov4(spark, str(tmp_path)).collect()}
    assert marks == {site: n >= 4 for site, n in coverage.items()}


def test_quota_of_all_positives(spark, tmp_path):
    def rows(middle, label, n):
        return [("A" * 8 + middle + "T" * 8, label)] * n

    listed = rows("ACGTA", 1, 300) + rows("ACGTA", 0, 400) + rows("CCGTA", 1, 200) + rows("CCGTA", 0, 50) + rows("GGGGG", 0, 90) + rows("TTTTT", 1, 10)
    spark.createDataFrame([(i, *r) for i, r in enumerate(listed)], "row_id bigint, k_mer string, methy_label int").write.parquet(f"{tmp_path}/features.parquet")
    got = {r["kmer"]: r["n_rows"] for r in sequences.QUERIES["kmer_quota_whole"](spark, str(tmp_path)).collect()}
    assert got == {"ACGTA": 300, "CCGTA": 50, None: 90}


def test_callers_have_their_full_size(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1,)], "row_id bigint").write.parquet(f"{tmp_path}/features.parquet")
    monkeypatch.setattr(pipelines, "called_by_encoder", lambda _, w: w)
    monkeypatch.setattr(pipelines, "called", lambda _, w: w)
    assert sum(v.size for v in scored.hte_score(spark, str(tmp_path)).values()) == 1_358_914
    assert scored.bilstm_score(spark, str(tmp_path))["out.w"].shape == (256, 2)


def test_samples_are_masked_and_cleaned_in_columns(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    samples = [1.0, nan, inf, None, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0, -inf, 13.0, 14.0, 15.0]
    row = (1, "n" * 20 + "J", [nan, None] + [2.0] * 19, [-inf] + [1.0] * 20, [4, 15, None, 40] + [0] * 17, [samples] * 21, None)
    features = spark.createDataFrame([row], "row_id bigint, k_mer string, signal_means array<double>, signal_stds array<double>, signal_lens array<int>, raw_signals array<array<double>>, tag int")
    monkeypatch.setattr(pipelines.models, "score", lambda frame, *_: frame)
    r = pipelines.called(features, {}).first()
    assert r["codes"][-1] == 0 and r["signal_means"][:3] == [0, 0, 2] and r["signal_stds"][:2] == [0, 1] and r["signal_lens"][:4] == [4, 15, 0, 40]
    assert r["raw_signals"][0] == [1, 0, 0, 0, 5, 6, 7, 8, 9, 10, 11, 0, 13, 14, 15]
    r = pipelines.called_by_encoder(features, {}).first()
    kept = [{i: x for i, x in enumerate(base) if x == x} for base in r["raw_signals"]]
    whole = {i: x for i, x in enumerate(samples) if x is not None and abs(x) < inf}
    assert kept[0] == {i: samples[i] for i in (5, 6, 7, 8)} and kept[1] == kept[3] == whole and kept[2] == kept[4] == {}


def test_every_signal_meets_its_alignment(spark, tmp_path):
    spark.createDataFrame([(i, [0.5] * 4) for i in range(0, 1200, 3)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, i * 7) for i in range(1500)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, sequences.QUERIES["signal_alignment_join_whole"](spark, str(tmp_path)).collect()))
    assert got == sorted((f"r{i}", 1, i * 7 % 60, 4) for i in range(0, 1200, 3) if i % 5 != 1)


def test_encoder_rows_are_dealt_to_many_tasks(spark, monkeypatch):
    """Tasks of equal size fill all cores to the end only if there are several a core; nothing that the encoder doesn't take goes along."""
    monkeypatch.setattr(pipelines.models, "score", lambda frame, *_: frame)
    row = (1, "ACGTACGTACGTACGTACGTA", [0.0] * 21, [1.0] * 21, [9] * 21, [[0.5] * 15] * 21, 1)
    features = spark.createDataFrame([(i, *row[1:]) for i in range(640)], "row_id bigint, k_mer string, signal_means array<double>, signal_stds array<double>, signal_lens array<int>, raw_signals array<array<double>>, tag int")
    frame = pipelines.called_by_encoder(features.coalesce(1), {})
    sizes = [len(part) for part in frame.select("row_id").rdd.glom().collect()]
    assert len(sizes) >= 8 * spark.sparkContext.defaultParallelism and sum(sizes) == 640 and max(sizes) < 2 * 640 / len(sizes)
    assert set(frame.columns) == {"row_id", "codes", "raw_signals", "tag", "k_mer"}
