import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays, names, signal
from strandline.operators import calib, freq, parse_rows, ranks, training
from strandline.plans import extract, pipelines
from strandline.streaming.sites import windowed_usage
from tests.test_skew_profile_parse import line


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def array(values, kind="array<double>"):
    return F.lit(None).cast(kind) if values is None else F.array(*[F.lit(v) for v in values]).cast(kind)


def test_arrays(spark):
    row = one(spark, arrays.centre_crop(array(range(7), "array<int>"), 3), arrays.centre_crop(array(range(7), "array<int>"), 3, 1), arrays.centre_crop(array([], "array<int>"), 3), arrays.centre_crop(array(None, "array<int>"), 3))
    assert [None if x is None else list(x) for x in row] == [[2, 3, 4], [3, 4, 5], [], None]
    at = [one(spark, arrays.segment_of(array([3, 0, 5], "array<int>"), F.lit(k)))[0] for k in (0, 2, 3, 7, 8)]
    assert [None if x is None else (x["segment"], x["offset"]) for x in at] == [(0, 0), (0, 2), (2, 0), (2, 4), None]
    assert one(spark, names.read_strand(F.lit("BaseCalled_template")), names.read_strand(F.lit("x")), names.read_strand(F.lit(None).cast("string")))[:2] == ("t", "c")


def test_traces_and_samples(spark):
    trace = F.array(*[array(x) for x in ([1, 0, 0, 1], [1, 0, 0, 1], [0, 3, 1, 0])])
    shares = one(spark, signal.base_probabilities(trace, array([1, 0, 1], "array<int>")), signal.base_probabilities(trace, array([0, 0, 1], "array<int>")))
    assert [list(x) for x in shares[0]] == [[0.5, 0, 0, 0.5], [0, 0.75, 0.25, 0]] and shares[1] is None
    values = [float(i) for i in range(50)]
    picked = list(one(spark, signal.sampled(array(values), 10, 3))[0])
    assert len(picked) == 10 and picked == sorted(picked) and set(picked) <= set(values) and list(one(spark, signal.sampled(array([1, 2]), 10))[0]) == [1, 2]
    assert list(one(spark, signal.trimmed(array(range(6)), F.lit(2), F.lit(None).cast("int")))[0]) == [2, 3, 4, 5] and list(one(spark, signal.trimmed(array(range(6)), F.lit(-2), F.lit(None).cast("int")))[0]) == [0, 1, 2, 3]


def test_places_and_first_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(20)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id int, v int")
    got = sorted((r["place"], r["v"], r["id"]) for r in ranks.placed(frame, [F.col("v"), F.col("id")]).collect())
    assert got == [(k, v, i) for k, (v, i) in enumerate(sorted((v, i) for i, v in rows))]
    assert {r["id"] for r in ranks.first_rows(frame, [F.col("v"), F.col("id")], 17).collect()} == {i for _, i in sorted((v, i) for i, v in rows)[:17]}
    assert ranks.first_rows(frame.limit(0), [F.col("v"), F.col("id")], 5).count() == 0


def test_choice_and_concat(spark):
    rows = spark.range(100).select(F.col("id").alias("row_id"))
    chosen = training.with_choice(rows, 30).collect()
    assert sum(r["chosen"] for r in chosen) == 30 and len(chosen) == 100
    named = rows.select(F.concat(F.lit("r"), "row_id").alias("row_id"))
    assert sum(r["chosen"] for r in training.with_choice(named, 30).collect()) == 30
    both = training.shuffled_concat(rows, spark.range(1000, 1050).select(F.col("id").alias("row_id")), chunk=40).collect()
    assert sorted(r["place"] for r in both) == list(range(150))
    for r in both:
        assert r["chunk"] == (r["row_id"] // 40 if r["row_id"] < 1000 else (r["row_id"] - 1000) // 21)
    assert [r["chunk"] for r in sorted(both, key=lambda r: r["place"])] == sorted(r["chunk"] for r in both)
    assert training.shuffled_concat(rows.limit(0), rows).count() == 100 and training.shuffled_concat(rows, rows.limit(0)).count() == 100


def test_denoise_balances_by_kmer(spark):
    rows = [(i, "good" if i % 2 else "bad", 1 if i % 2 else 0) for i in range(200)] + [(1000 + i, "bad", 1) for i in range(10)] + [(2000 + i, "good", 0) for i in range(6)]
    frame = spark.createDataFrame(rows, "row_id bigint, kmer string, label int")
    kept = training.denoise(frame, training.kmer_scorer, rounds=2, iterations=3)
    assert {(r["kmer"], r["label"]) for r in kept.collect()} == {("good", 1), ("bad", 0)} and kept.count() == 200
    only = training.denoise(frame, training.kmer_scorer, rounds=2, iterations=3, negatives=False, balance="kmer")
    counts = {(r["kmer"], r["label"]): r["count"] for r in only.groupBy("kmer", "label").count().collect()}
    assert counts["good", 1] == 100 and counts["good", 0] == 6 and counts["bad", 0] == 94
    assert training.denoise(frame.limit(0), training.kmer_scorer, iterations=2).count() == 0


def test_calibration_passes_other_lines_through(spark, tmp_path):
    good = ["chr1", "5", "+", ".", "r1", ".", "0.4", "0.6", "1", "ACGTA"]
    lines = ["\t".join(good), "too\tshort", "\t".join([*good[:1], "x", *good[2:]]), "\t".join([*good[:1], "9", *good[2:7], "0.2", *good[8:]])]
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n")
    scorer = lambda w: w.withColumn("score", F.lit(0.25))
    got = {r["row_id"]: r["value"] for r in pipelines.calibrated_lines(spark, [str(tmp_path / "a.tsv")], scorer).collect()}
    assert got[1] == lines[1] and got[2] == lines[2] and got[0].split("\t")[6:9] == ["0.750000", "0.250000", "0"] and len(got) == 4
    calls = spark.createDataFrame([(1, "r", "c", 5, 0.5, 0.5, 1), (2, None, "c", 6, 0.5, float("nan"), 7), (3, "r", None, None, None, None, None)], "row_id bigint, readname string, chrom string, pos bigint, prob_0 double, prob_1 double, called_label int")
    out = {r["row_id"]: r for r in calib.calibrated_all(calls, F.col("readname").isNotNull() & F.col("pos").isNotNull(), scorer).collect()}
    assert out[1]["prob_1"] == 0.25 and out[1]["called_label"] == 0 and math.isnan(out[2]["prob_1"]) and out[2]["called_label"] == 7 and out[3]["prob_1"] is None


def test_sites_in_order_and_checked(spark):
    sites = spark.createDataFrame([("b", 1, 3, 1, 2), ("a", 10, 1, 1, 0), ("a", 9, 1, 0, 1)], "chrom string, pos bigint, coverage bigint, count_modified bigint, count_unmodified bigint")
    assert [(r["chrom"], r["pos"]) for r in sorted(freq.sorted_sites(freq.check_counts(sites)).collect(), key=lambda r: r["place"])] == [("a", 9), ("a", 10), ("b", 1)]
    with pytest.raises(Exception, match="counts differ"):
        freq.check_counts(sites.withColumn("coverage", F.lit(9).cast("bigint"))).collect()


def test_scoring_rows_and_repeated_values(spark):
    short = "\t".join(line().split("\t")[:12])
    cases = [(1, line()), (2, short), (3, "a\tb"), (4, None), (5, ""), (6, line(c0="chr9")), (7, line(c7="x," + ",".join(["1"] * 20)))]
    frame = spark.createDataFrame(cases, "line_no bigint, line_text string").withColumn("file_name", F.lit("f"))
    rows = {r["line_no"]: r for r in parse_rows.scoring_rows(frame, exclude=["chr9"]).collect()}
    assert set(rows) == {1, 2, 7} and rows[7]["signal_means"][0] is None and len(rows[2]["raw_signals"]) == 21
    typed = parse_rows.valid_rows(spark.createDataFrame([(1, "f", line() + "\t0.4"), (2, "f", line())], "line_no bigint, file_name string, line_text string"))
    got = {r["line_no"]: r for r in parse_rows.with_repeated_values(typed).collect()}
    assert list(got[1]["gc_contents"]) == [0.4] * 21 and got[2]["gc_contents"] is None and list(got[1]["tags"]) == [0] * 21


def test_called_reads(spark):
    seq = "TTCGACGTCG"
    signals = spark.createDataFrame([("a", [float(i % 7) for i in range(40)])], "read_id string, signal array<double>")
    alignments = spark.createDataFrame([("a", 0, 9, "c", 100, "10M", seq, 2, [1] * 10, 0, None, 0)], "read_id string, flag int, mapq int, ref_name string, ref_start bigint, cigar string, seq string, stride int, moves array<int>, ts int, sp int, nm int")
    scorer = lambda rows: rows.select("row_id", F.lit(0.25).alias("prob_0"), F.lit(0.75).alias("prob_1"), F.lit(1).alias("called_label"), "k_mer")
    got = sorted((r["pos"], r["readname"], r["prob_1"]) for r in pipelines.called_reads(signals, alignments, scorer, extract.Settings(kmer=3, samples=3)).collect())
    assert got == [(102, "a", 0.75), (105, "a", 0.75), (108, "a", 0.75)]


def test_windowed_usage_of_a_stream(spark, tmp_path):
    folder = tmp_path / "calls"
    rows = spark.createDataFrame([("c", f"2024-01-01 0{h}:30:00", h % 2) for h in range(6)], "chrom string, at string, called_label int").select("chrom", F.to_timestamp("at").alias("called_at"), "called_label")
    rows.write.parquet(str(folder))
    stream = spark.readStream.schema(rows.schema).parquet(str(folder))
    query = windowed_usage(stream).writeStream.outputMode("complete").format("memory").queryName("usage").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["n_calls"], r["n_modified"]) for r in spark.table("usage").collect()) == [(1, 0)] * 3 + [(1, 1)] * 3
