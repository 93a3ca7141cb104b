import math

import pytest
from pyspark.sql import functions as F

from strandline.plans import extract
from strandline.sources import sam
from strandline.sources.text import write_lines

SIGNALS = "read_id string, signal array<double>"
ALIGNED = "read_id string, flag int, mapq int, ref_name string, ref_start bigint, cigar string, seq string, stride int, moves array<int>, ts int, sp int, nm int"
MOVES = [1, 0, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1]  # ten bases
SIGNAL = [math.sin(i) for i in range(30)]
BACK = {"A": "T", "C": "G", "G": "C", "T": "A"}


def reverse(seq):
    return "".join(BACK[x] for x in reversed(seq))


def reads(spark, aligned):
    ids = {r[0] for r in aligned}
    return spark.createDataFrame([(i, SIGNAL) for i in ids], SIGNALS), spark.createDataFrame(aligned, ALIGNED)


def test_sites_of_forward_reverse_and_unmapped_reads(spark):
    seq = "TTCGACGTCG"
    aligned = [
        ("fwd", 0, 9, "c", 100, "1S3M1I2M2D3M", seq, 2, MOVES, 2, None, 0),
        ("rev", 16, 9, "c", 100, "1S3M1I2M2D3M", reverse(seq), 2, MOVES, 2, 1, 0),
        ("none", 4, 9, None, None, None, seq, 2, MOVES, -3, None, None),
        ("low", 0, 0, "c", 100, "10M", seq, 2, MOVES, 2, None, 0),
        ("again", 2048, 9, "c", 100, "10M", seq, 2, MOVES, 2, None, 0),
        ("odd", 0, 9, "c", 100, "10M", seq, 2, [0, *MOVES[1:]], 2, None, 0),
        ("short", 0, 9, "c", 100, "10M", seq, 2, MOVES, 20, None, 0),
        ("bare", 0, 9, "c", 100, "10M", seq, 2, None, 2, None, 0),
        ("wrong", 0, 9, "c", 100, "10M", seq, 2, MOVES, 2, None, 5),
    ]
    settings = extract.Settings(kmer=3, samples=3, identity=0.8)
    signals, alignments = reads(spark, aligned)
    status = {r["read_id"]: r["status"] for r in extract.prepared_reads(signals, alignments, settings).collect()}
    assert status == {"fwd": "ok", "rev": "ok", "none": "ok", "low": "low_mapq", "again": "secondary", "odd": "bad_moves", "short": "bad_moves", "bare": "no_moves", "wrong": "low_identity"}
    rows = extract.features(signals, alignments, settings).collect()
    at = {(r["readname"], r["loc"]): (r["chrom"], r["pos"], r["strand"]) for r in rows}
    # forward: loc 2 -> aligned 1; loc 5 -> aligned 4, behind the insertion. The last site lies at the edge of the k-mer.
    assert at["fwd", 2] == ("c", 101, "+") and at["fwd", 5] == ("c", 103, "+") and at["none", 2] == (".", -1, ".")
    # reverse: steps from the end: three matches, two deleted, two matches, one inserted, three matches; the reference ends at 110
    assert at["rev", 2] == ("c", 107, "-") and ("rev", 5) not in at
    first = next(r for r in rows if (r["readname"], r["loc"]) == ("fwd", 2))
    trimmed = SIGNAL[2:]
    median = sorted(trimmed)[13] / 2 + sorted(trimmed)[14] / 2
    spread = sorted(abs(x - median) for x in trimmed)
    scaled = [(x - median) / ((spread[13] + spread[14]) / 2 / 0.6744897501960817) for x in trimmed]
    base = scaled[6:8]  # base 2 has one move of two samples
    assert first["k_mer"] == "TCG" and list(first["signal_lens"]) == [2, 2, 4] and first["signal_means"][1] == pytest.approx(sum(base) / 2) and list(first["raw_signals"][1]) == [pytest.approx(base[0]), pytest.approx(base[1]), 0.0]
    listed = spark.createDataFrame([("c", 101, "+"), ("c", 103, "-")], "chrom string, pos bigint, strand string")
    assert [(r["readname"], r["loc"]) for r in extract.features(signals, alignments, settings, positions=listed).collect()] == [("fwd", 2)]
    lengths = spark.createDataFrame([("c", 1000)], "contig string, length int")
    placed = {(r["readname"], r["loc"]): r["pos_in_strand"] for r in extract.features(signals, alignments, settings, reference=lengths).collect()}
    assert placed["fwd", 2] == "101" and placed["rev", 2] == str(999 - 107)
    assert {r["readname"] for r in extract.features(signals, alignments, settings, reference=lengths.limit(0)).collect()} == {"none"}


def test_tags_near_any_c(spark):
    seq = "CTTTTCGTTTTTTTTTTTTTTTTTCGTT"
    moves = [1] * len(seq)
    signals = spark.createDataFrame([("r", [float(i % 5) for i in range(60)])], SIGNALS)
    alignments = spark.createDataFrame([("r", 0, 9, "c", 0, f"{len(seq)}M", seq, 2, moves, 0, None, 0)], ALIGNED)
    tags = lambda any_c: {r["loc"]: r["tag"] for r in extract.features(signals, alignments, extract.Settings(kmer=3, samples=2, any_c=any_c, scaling="zscore")).collect()}
    assert tags(False) == {5: 0, 24: 0} and tags(True) == {5: 1, 24: 0}


def test_sam_round_trip_with_tags(spark, tmp_path):
    seq = "TTCGACGTCGAA"
    aligned = [("b", 0, 9, "c", 100, "12M", seq, 2, [1] * 12, 2, None, 0), ("a", 0, 9, "c", 50, "12M", "A" * 12, 2, [1] * 12, 2, 0, 0), ("u", 4, 9, None, None, None, seq, 2, [1] * 12, 2, None, None)]
    signals, alignments = reads(spark, aligned)
    prepared = extract.prepared_reads(signals, alignments, extract.Settings(kmer=3, samples=2))
    called = spark.createDataFrame([("b", 5, 0.25), ("b", 2, 1.0), ("gone", 1, 0.5)], "read_id string, loc int, prob_1 double")
    tagged = extract.tagged_reads(prepared, called)
    lines = [r["line"] for r in sam.sam_lines(tagged).collect()]
    assert [x.split("\t")[0] for x in lines] == ["a", "b", "u"] and "MM:Z:C+m?,0,0;\tML:B:C,255,64" in lines[1] and "MM:Z" not in lines[0]
    write_lines(sam.sam_lines(tagged).select(F.col("line").alias("value")), str(tmp_path / "x.sam"))
    back = {r["read_id"]: r for r in sam.read_sam(spark, [str(tmp_path / "x.sam")]).collect()}
    for r in aligned:
        got = back[r[0]]
        assert (got["flag"], got["mapq"], got["ref_name"], got["ref_start"], got["cigar"], got["seq"], got["stride"], list(got["moves"]), got["ts"], got["sp"], got["nm"]) == r[1:]
    assert list(back["b"]["ml"]) == [255, 64] and back["a"]["mm"] is None
    (tmp_path / "y.sam").write_text("@HD\tVN:1.6\nq\t0\tc\t0\t9\t*\t*\t0\t0\tACGT\t*\tpi:Z:parent\tmv:B:c,5,1,0\nbroken\t1\n")
    row = sam.read_sam(spark, [str(tmp_path / "y.sam")]).collect()
    assert len(row) == 1 and row[0]["read_id"] == "parent" and row[0]["ref_start"] is None and row[0]["stride"] == 5
