"""Queries over calls: site frequencies, histograms, windows, filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import calib, filters, freq
from strandline.session import maybe_broadcast, table

Query = Callable[[SparkSession, str], DataFrame]
INCLUDED, EXCLUDED = ["chr1", "chr5", "chrM", "chr9"], ["chr9"]
MIN_COVERAGE = 20


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return freq.usable(table(spark, d, "calls"))


def _sites(spark: SparkSession, d: str, min_coverage: int = MIN_COVERAGE) -> DataFrame:
    return freq.site_histograms(_calls(spark, d), min_coverage=min_coverage)


def call_freq_count(spark: SparkSession, d: str) -> DataFrame:
    sites = freq.site_counts(_calls(spark, d))
    return sites.withColumns({c: F.round(c, 6) for c in ("prob_0_sum", "prob_1_sum", "modification_frequency")})


def call_freq_bed(spark: SparkSession, d: str) -> DataFrame:
    return freq.bed(freq.site_counts(_calls(spark, d)))


def call_usage_ratio(spark: SparkSession, d: str) -> DataFrame:
    return freq.usage(_calls(spark, d))


def ambiguous_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = freq.unambiguous(_calls(spark, d), 0.5)
    return kept.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_calls"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


def site_majority_strand(spark: SparkSession, d: str) -> DataFrame:
    return freq.majority_strand(_calls(spark, d))


def site_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each bin of each site, bins without rows left out."""
    counted = _calls(spark, d).groupBy("chrom", "pos").agg(freq.histogram(F.col("prob_1")).alias("h"))
    return counted.select("chrom", "pos", F.posexplode("h").alias("bin", "n_calls")).where("n_calls > 0")


def site_histogram_norm(spark: SparkSession, d: str, min_coverage: int = MIN_COVERAGE) -> DataFrame:
    return _sites(spark, d, min_coverage).select("chrom", "pos", "coverage", "is_anchor", F.posexplode("hist").alias("bin", "height")).where("height > 0")


def anchor_rank(spark: SparkSession, d: str, min_coverage: int = MIN_COVERAGE) -> DataFrame:
    return freq.with_anchor_rank(_sites(spark, d, min_coverage)).select("chrom", "pos", "rank_before")


def anchor_neighbours(spark: SparkSession, d: str, min_coverage: int = MIN_COVERAGE) -> DataFrame:
    return freq.anchor_neighbours(_sites(spark, d, min_coverage)).select("chrom", "pos", "slot", "near_pos")


def anchor_windows(spark: SparkSession, d: str, min_coverage: int = MIN_COVERAGE) -> DataFrame:
    """Distances of each site's window, with padding."""
    return freq.site_windows(_sites(spark, d, min_coverage)).select("chrom", "pos", F.posexplode("dist").alias("place", "dist"))


def site_histogram_norm_cov4(spark: SparkSession, d: str) -> DataFrame:
    """With the coverage that the operator and the pipelines ask of anchors, as the three below."""
    return site_histogram_norm(spark, d, freq.MIN_COVERAGE)


def anchor_rank_cov4(spark: SparkSession, d: str) -> DataFrame:
    return anchor_rank(spark, d, freq.MIN_COVERAGE)


def anchor_neighbours_cov4(spark: SparkSession, d: str) -> DataFrame:
    return anchor_neighbours(spark, d, freq.MIN_COVERAGE)


def anchor_windows_cov4(spark: SparkSession, d: str) -> DataFrame:
    return anchor_windows(spark, d, freq.MIN_COVERAGE)


def read_features(spark: SparkSession, d: str) -> DataFrame:
    out = calib.read_features(_calls(spark, d))
    return out.select("readname", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("log_sites", "mean_prob", "std_prob")])


def _mixed(column: str) -> F.Column:
    """An array as one number that tells its order."""
    return F.aggregate(F.transform(column, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def read_windows(spark: SparkSession, d: str) -> DataFrame:
    """One row per call: its window's probabilities, offsets and validity, each as a sum weighted by place."""
    out = calib.read_windows(_calls(spark, d).select("row_id", "readname", "chrom", "pos", "prob_1"))
    return out.select("row_id", F.round(_mixed("probs"), 6).alias("prob_mix"), F.round(_mixed("offsets"), 1).alias("offset_mix"), F.round(_mixed("valid"), 1).alias("valid_mix"))


def calibrated_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = calib.read_windows(_calls(spark, d).select("row_id", "readname", "chrom", "pos", "prob_0", "prob_1", "called_label"))
    scored = calls.withColumn("score", calib.linear_scorer(F.col("probs"), F.col("offsets"), F.col("valid")))
    return calib.rewrite(scored, "score").select("row_id", F.round(F.col("prob_1") + 1e-8, 4).alias("prob_1"), (F.col("called_label")).alias("called_label"))


def chrom_include_exclude(spark: SparkSession, d: str) -> DataFrame:
    return filters.contigs(_calls(spark, d), INCLUDED, EXCLUDED).groupBy("chrom", "strand").agg(F.count(F.lit(1)).alias("n_calls"))


def positions_semi(spark: SparkSession, d: str) -> DataFrame:
    kept = filters.at_positions(_calls(spark, d), table(spark, d, "positions"))
    return kept.select("row_id", "chrom", "pos", "strand")


def read_overlap(spark: SparkSession, d: str) -> DataFrame:
    return filters.overlap(table(spark, d, "calls"), table(spark, d, "features"), "readname")


def call_union(spark: SparkSession, d: str) -> DataFrame:
    """Calls of early and late loads together, counted by load."""
    calls = table(spark, d, "calls")
    both = calls.where("load_id <= 4").unionByName(calls.where("load_id > 4"))
    return both.join(maybe_broadcast(table(spark, d, "loads").select("load_id", "file_name")), "load_id").groupBy("file_name").agg(F.count(F.lit(1)).alias("n_calls"))


def site_union(spark: SparkSession, d: str) -> DataFrame:
    """Sites of calls, features and listed positions together: how many rows each table has of them."""
    named = lambda name: table(spark, d, name).select("chrom", "pos", F.lit(name).alias("t")).dropna()
    both = named("calls").unionByName(named("features")).unionByName(named("positions"))
    return both.groupBy("chrom", "pos").agg(*[F.count_if(F.col("t") == name).alias(f"n_{name}") for name in ("calls", "features", "positions")])


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        call_freq_count, call_freq_bed, call_usage_ratio, ambiguous_filter, site_majority_strand, site_histogram, site_histogram_norm, anchor_rank, anchor_neighbours, anchor_windows, read_features, read_windows, calibrated_calls,
        site_histogram_norm_cov4, anchor_rank_cov4, anchor_neighbours_cov4, anchor_windows_cov4,
        chrom_include_exclude, positions_semi, read_overlap, call_union, site_union,
    )
}

USABLE = """u as (select * from calls where chrom is not null and pos is not null and readname is not null and prob_0 between 0 and 1 and not isnan(prob_0)
  and prob_1 between 0 and 1 and not isnan(prob_1) and called_label in (0, 1))"""
_EDGES = "least(" + " + ".join(f"(prob_1 >= {i} * 0.05::double)::int" for i in range(1, 20)) + ", 19)"
_SITES = f"""{USABLE},
b as (select chrom, pos, {_EDGES} as bin, count(*) as n_calls from u group by 1, 2, 3),
s as (select chrom, pos, sum(n_calls)::bigint as coverage, sum(n_calls) >= {MIN_COVERAGE} as is_anchor, sqrt(sum(n_calls * n_calls)::double) as norm, from b group by 1, 2)"""
_WINDOW = "over (partition by readname, chrom order by pos, row_id)"
_SPAN = [f"lag({{}}, {-k}) {_WINDOW}" if k < 0 else f"lead({{}}, {k}) {_WINDOW}" if k else "{}" for k in range(-5, 6)]
_P = [f"coalesce({x.format('prob_1')}, 0)" for x in _SPAN]
_O = [f"coalesce(abs({x.format('pos')} - pos), 0)::double" for x in _SPAN]
_V = [f"(case when {x.format('pos')} is null then 0 else 1 end)" for x in _SPAN]

ORACLES: dict[str, str] = {
    "call_freq_count": f"""with {USABLE}, k as (select * from u where abs(prob_0 - prob_1) >= 0.5)
select chrom, pos, arg_min({{'s': strand}}, row_id).s as strand, arg_min({{'s': pos_in_strand}}, row_id).s as pos_in_strand, round(sum(prob_0), 6) as prob_0_sum, round(sum(prob_1), 6) as prob_1_sum,
  count(*) filter (called_label = 1) as count_modified, count(*) filter (called_label = 0) as count_unmodified, count(*) as coverage,
  round(count(*) filter (called_label = 1) / count(*)::double, 6) as modification_frequency, arg_min({{'s': k_mer}}, row_id).s as k_mer from k group by 1, 2""",
    "call_freq_bed": f"""with {USABLE}, k as (select * from u where abs(prob_0 - prob_1) >= 0.5)
select chrom, pos as start, pos + 1 as "end", '.' as name, count(*) as score, arg_min({{'s': strand}}, row_id).s as strand, pos as thick_start, pos + 1 as thick_end, '0,0,0' as rgb, count(*) as coverage,
  round_even(count(*) filter (called_label = 1) / count(*)::double * 100 + 0.001, 0)::int as percent from k group by chrom, pos""",
    "call_usage_ratio": f"""with {USABLE} select count(*) filter (abs(prob_0 - prob_1) >= 0.5) as n_used, count(*) as n_calls, round(count(*) filter (abs(prob_0 - prob_1) >= 0.5) / count(*)::double, 6) as ratio from u""",
    "ambiguous_filter": f"""with {USABLE} select chrom, count(*) as n_calls, min(row_id) as first_row, max(row_id) as last_row from u where abs(prob_0 - prob_1) >= 0.5 group by 1""",
    "site_majority_strand": f"""with {USABLE}, c as (select chrom, pos, strand, count(*) as n, min(row_id) as f from u where strand is not null group by 1, 2, 3)
select chrom, pos, first(strand order by n desc, f) as strand, sum(n)::bigint as coverage from c group by 1, 2""",
    "site_histogram": f"with {_SITES} select chrom, pos, bin, n_calls from b",
    "site_histogram_norm": f"with {_SITES} select chrom, pos, coverage, is_anchor, bin, round(n_calls / (norm + 1e-8), 6) as height from b join s using (chrom, pos)",
    "anchor_rank": f"with {_SITES} select chrom, pos, coalesce(sum(is_anchor::int) over (partition by chrom order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as rank_before from s",
    "anchor_neighbours": f"""with {_SITES}, a as (select chrom, pos from s where is_anchor),
pairs as (select s.chrom, s.pos, a.pos as near_pos, row_number() over (partition by s.chrom, s.pos, a.pos > s.pos order by abs(a.pos - s.pos)) as r from s join a on a.chrom = s.chrom and a.pos <> s.pos)
select chrom, pos, (case when near_pos < pos then -r else r end)::int as slot, near_pos from pairs where r <= 5""",
    "anchor_windows": f"""with {_SITES}, a as (select chrom, pos from s where is_anchor),
pairs as (select s.chrom, s.pos, a.pos as near_pos, row_number() over (partition by s.chrom, s.pos, a.pos > s.pos order by abs(a.pos - s.pos)) as r from s join a on a.chrom = s.chrom and a.pos <> s.pos),
n as (select chrom, pos, case when near_pos < pos then -r else r end as slot, near_pos from pairs where r <= 5),
e as (select chrom, min(pos) as first_pos, max(pos) as last_pos from s group by 1)
select s.chrom, s.pos, (k.k + 5)::int as place, case when k.k = 0 then 0 else abs(coalesce(n.near_pos, case when k.k < 0 then first_pos - 10000 else last_pos + 10000 end) - s.pos) end::bigint as dist
from s join e using (chrom) cross join (select unnest(range(-5, 6)) as k) k left join n on n.chrom = s.chrom and n.pos = s.pos and n.slot = k.k""",
    "read_features": f"""with {USABLE} select readname, round(ln(1 + count(*)) + 1e-9, 5) as log_sites, round(avg(prob_1) + 1e-9, 5) as mean_prob, round(stddev_pop(prob_1) + 1e-9, 5) as std_prob from u group by 1""",
    "read_windows": f"""with {USABLE} select row_id, round({" + ".join(f"{i + 1} * {x}" for i, x in enumerate(_P))}, 6) as prob_mix, round({" + ".join(f"{i + 1} * {x}" for i, x in enumerate(_O))}, 1) as offset_mix,
  round(({" + ".join(f"{i + 1} * {x}" for i, x in enumerate(_V))})::double, 1) as valid_mix from u""",
    "calibrated_calls": f"""with {USABLE}, w as (select row_id, {", ".join(f"{p} as p{i}, {v} / (1 + least({o} / 1000, 10)) as w{i}" for i, (p, o, v) in enumerate(zip(_P, _O, _V)))} from u),
s as (select row_id, round(({" + ".join(f"p{i} * w{i}" for i in range(11))}) / ({" + ".join(f"w{i}" for i in range(11))}), 6) as p from w)
select row_id, round(p + 1e-8, 4) as prob_1, (p >= 0.5)::int as called_label from s""",
    "chrom_include_exclude": f"with {USABLE} select chrom, strand, count(*) as n_calls from u where chrom in ('chr1', 'chr5', 'chrM') group by 1, 2",
    "positions_semi": f"with {USABLE} select row_id, chrom, pos, strand from u where exists (select 1 from positions p where p.chrom = u.chrom and p.pos = u.pos and p.strand = u.strand)",
    "read_overlap": """with a as (select distinct readname from calls where readname is not null), b as (select distinct readname from features where readname is not null)
select (select count(*) from a) as n_left, (select count(*) from b) as n_right, (select count(*) from a join b using (readname)) as n_both, round((select count(*) from a join b using (readname)) / (select count(*) from a)::double, 6) as share""",
    "site_union": """with a as (select chrom, pos, 'c' as t from calls union all select chrom, pos, 'f' from features union all select chrom, pos, 'p' from positions)
select chrom, pos, count(*) filter (t = 'c') as n_calls, count(*) filter (t = 'f') as n_features, count(*) filter (t = 'p') as n_positions from a where chrom is not null and pos is not null group by 1, 2""",
    "call_union": "select file_name, count(*) as n_calls from calls join loads using (load_id) group by 1",
}

#: With anchors from coverage 4 nearly every site is one, so their neighbours come from windows and not from a join of all pairs.
_SITES_4 = f"""{USABLE},
b as (select chrom, pos, {_EDGES} as bin, count(*) as n_calls from u group by 1, 2, 3),
s as (select chrom, pos, sum(n_calls)::bigint as coverage, sum(n_calls) >= {freq.MIN_COVERAGE} as is_anchor, sqrt(sum(n_calls * n_calls)::double) as norm from b group by 1, 2)"""
_SLOTS = [k for k in range(-5, 6) if k]
_NEAR_4 = f"""{_SITES_4},
w as (select chrom, pos, {", ".join(f"{'lag' if k < 0 else 'lead'}(case when is_anchor then pos end, {abs(k)} ignore nulls) over (partition by chrom order by pos) as n{i}" for i, k in enumerate(_SLOTS))} from s),
n as (select chrom, pos, unnest({_SLOTS})::int as slot, unnest([{", ".join(f"n{i}" for i in range(10))}]) as near_pos from w)"""

ORACLES |= {
    "site_histogram_norm_cov4": f"with {_SITES_4} select chrom, pos, coverage, is_anchor, bin, round(n_calls / (norm + 1e-8), 6) as height from b join s using (chrom, pos)",
    "anchor_rank_cov4": f"with {_SITES_4} select chrom, pos, coalesce(sum(is_anchor::int) over (partition by chrom order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as rank_before from s",
    "anchor_neighbours_cov4": f"with {_NEAR_4} select chrom, pos, slot, near_pos from n where near_pos is not null",
    "anchor_windows_cov4": f"""with {_NEAR_4}, e as (select chrom, min(pos) as first_pos, max(pos) as last_pos from s group by 1)
select chrom, pos, (slot + 5)::int as place, abs(coalesce(near_pos, case when slot < 0 then first_pos - 10000 else last_pos + 10000 end) - pos)::bigint as dist from n join e using (chrom)
union all select chrom, pos, 5, 0 from s""",
}
