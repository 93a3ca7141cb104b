import csv
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.operators.parse_rows import parse_lines, rejected_lines, valid_rows
from strandline.operators.profile import CALL_COLUMNS, calls_profile, load_issues
from strandline.operators.ranks import with_rank, with_running_total
from strandline.operators.skew import heavy_keys, salted_aggregate, split_join


def test_salted_aggregate_equals_plain(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(300)}", rng.random(), "clash") for i in range(5000)]
    frame = spark.createDataFrame(rows, "row_id bigint, key string, v double, _salt string")
    assert [r["key"] for r in heavy_keys(frame, ["key"], 0.05)] == ["hot"]
    got = {r["key"]: (r["n"], round(r["s"], 6), r["lo"], r["hi"]) for r in salted_aggregate(frame.drop("_salt"), ["key"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, ["row_id"]).collect()}
    plain = {r["key"]: (r["n"], round(r["s"], 6), r["lo"], r["hi"]) for r in frame.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    assert got == plain
    assert salted_aggregate(frame.limit(0), ["key"], {"n": ("count", F.lit(1))}, ["row_id"]).count() == 0


@pytest.mark.parametrize("limit", [0, 10**6])
def test_split_join_both_ways(spark, limit):
    left = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i}") for i in range(400)], "id int, key string")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 300, 2)]], "key string, v int")
    for how in ("left", "inner"):
        got = sorted(map(tuple, split_join(left, right, "key", how, broadcast_rows=limit).select("id", "key", "v").collect()), key=repr)
        assert got == sorted(map(tuple, left.join(right, "key", how).select("id", "key", "v").collect()), key=repr)


def test_ranks_are_permutations(spark):
    frame = spark.createDataFrame([("a" if i % 3 else "b", i, i % 5) for i in range(300)], "g string, id int, n int")
    got = with_rank(frame, ["g"], ["id"], 3, buckets=8).collect()
    for g in "ab":
        own = [r["rank"] for r in got if r["g"] == g]
        assert sorted(own) == list(range(1, len(own) + 1))
    sums = with_running_total(frame, ["g"], ["id"], F.col("n"), 3, buckets=8).collect()
    for g in "ab":
        own = sorted((r["running_before"], r["n"]) for r in sums if r["g"] == g)
        assert own[-1][0] + own[-1][1] == sum(r["n"] for r in sums if r["g"] == g)


CALLS = "load_id bigint, prob_1 double, called_label int, strand string, num string"


def test_profile_edges(spark):
    rows = [(1, 0.1, 0, "+", "x"), (1, None, None, None, "x"), (1, float("nan"), 9, "?", "x"), (2, 0.95, 1, "-", "x"), (2, 1.0, 1, "-", "x"), (2, 0.0, 1, "-", "x"), (None, 0.5, 1, "+", "x"), (3, None, None, None, "x"), (4, 0.5, 1, "-", "x")]
    frame = spark.createDataFrame(rows, CALLS)
    got = {(r["load_id"], r["col_name"]): r for r in calls_profile(frame).collect()}
    one = got[1, "prob_1"]
    assert (one["n_rows"], one["n_null"], one["n_violation"], one["n_distinct"], one["q50"]) == (3, 1, 1, 1, 0.1)
    assert got[2, "prob_1"]["q50"] == 0.95 and got[2, "prob_1"]["ks"] == pytest.approx(2 / 3, abs=1e-6) and got[2, "prob_1"]["moved_share"] == 1.0
    assert got[3, "prob_1"]["ks"] is None and got[4, "prob_1"]["ks"] is None
    issues = {tuple(r) for r in load_issues(frame).collect()}
    assert {(1, "prob_1", "null_rate"), (1, "strand", "violation"), (2, "called_label", "drift")} <= issues and not any(i[0] in (3, 4) and i[2] == "drift" for i in issues)
    assert load_issues(frame.limit(0)).count() == 0 and calls_profile(frame.limit(0)).count() == 0
    assert len(CALL_COLUMNS) == 3


def line(**change):
    fields = ["chr1", "5", "+", ".", "read", ".", "A" * 21, ",".join(["1.5"] * 21), ",".join(["-2e-1"] * 21), ",".join(["3"] * 21), ";".join([",".join(["0.5"] * 15)] * 21), "1", "0"]
    for k, v in change.items():
        fields[int(k[1:])] = v
    return "\t".join(fields)


CASES = [
    (line(), None),
    ("  " + line() + "\t\r", None),
    (line() + "\t0.4", None),
    (line(f4='"re""ad"'), None),
    (line(f4='"re\tad"'), None),
    (line(f4='re"ad'), "quoting"),
    (line(f4='"read'), "quoting"),
    (line(f4='"re"ad'), "quoting"),
    (None, "column_count"),
    ("", "column_count"),
    (line() + "\t1\t2", "column_count"),
    (line(f7=",".join(["1"] * 20)), "bad_value"),
    (line(f7=",".join(["nan"] * 21)), "bad_value"),
    (line(f8=",".join(["1e999"] * 21)), "bad_value"),
    (line(f8=",".join(["1_0"] * 21)), "bad_value"),
    (line(f9=",".join(["-1"] * 21)), "bad_value"),
    (line(f9=",".join(["+1"] * 21)), "bad_value"),
    (line(f9=",".join(["٣"] * 21)), "bad_value"),
    (line(f10=";".join([",".join(["0.5"] * 15)] * 20)), "bad_value"),
    (line(f11="01"), "bad_value"),
    (line(f12=" 1"), "bad_value"),
    (line(f11="x", f4='a"b'), "quoting"),
    (line(f1="far"), None),
    (line(f9=",".join(["99999999999"] * 21)), None),
]


def test_parse_reasons(spark):
    frame = spark.createDataFrame([(i, "f", t, "x") for i, (t, _) in enumerate(CASES)], "line_no bigint, file_name string, line_text string, reason string")
    assert {r["line_no"]: r["reason"] for r in rejected_lines(frame).collect()} == {i: reason for i, (_, reason) in enumerate(CASES) if reason}
    rows = {r["line_no"]: r for r in valid_rows(frame).collect()}
    assert rows[3]["readname"] == 're"ad' and rows[4]["readname"] == "re\tad" and rows[0]["signal_stds"][0] == -0.2 and rows[2]["gc_content"] == 0.4
    assert rows[22]["pos"] is None and rows[23]["signal_lens"][0] is None and len(rows[0]["raw_signals"]) == 21
    assert parse_lines(frame.limit(0)).count() == 0


def test_parse_long_field(spark):
    frame = spark.createDataFrame([(1, "f", line(f4="r" * 300_000))], "line_no bigint, file_name string, line_text string")
    assert valid_rows(frame).select(F.length("readname")).first()[0] == 300_000
    assert csv and re
