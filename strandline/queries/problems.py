"""Queries for the data-quality and skew operators over the tables of the domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.parse_rows import reject_counts, rejected_lines, valid_rows
from strandline.operators.profile import calls_profile, load_issues
from strandline.operators.skew import MIN_SHARE, heavy_counts, salted_aggregate
from strandline.operators.spikes import flag_implausible, implausible_bases
from strandline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_bases(table(spark, d, "features"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many bases of each read and field are damaged, by reason."""
    features = table(spark, d, "features")
    flags = flag_implausible(features)
    return flags.groupBy("row_id", "field_name", "reason").agg(F.count(F.lit(1)).alias("n_bases"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return load_issues(table(spark, d, "calls"))


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    return calls_profile(table(spark, d, "calls"))


def _site_key() -> F.Column:
    return F.when(F.col("chrom").isNotNull() & F.col("pos").isNotNull(), F.concat_ws("||", F.col("chrom"), F.col("pos").cast("string")))


def _probability() -> F.Column:
    """prob_1 where it is a probability; other values count as missing in sums and means."""
    return F.when(F.col("prob_1").between(0.0, 1.0) & ~F.isnan("prob_1"), F.col("prob_1"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls")
    keys = F.array(F.struct(F.lit("site").alias("key_kind"), _site_key().alias("key_value")), F.struct(F.lit("read").alias("key_kind"), F.col("readname").alias("key_value")))
    long = calls.select("row_id", F.explode(keys).alias("k")).select("row_id", "k.*")
    # both kinds in one pass: each call is two rows here, so the share of a key halves
    return heavy_counts(long, ["key_kind", "key_value"], ["row_id"], MIN_SHARE / 2).select("key_kind", "key_value")


def p4_site_results(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls").select("row_id", _site_key().alias("site_key"), "called_label", _probability().alias("p"))
    sums = {"coverage": ("count", F.lit(1)), "n_modified": ("sum", F.when(F.col("called_label") == 1, 1).otherwise(0)), "s": ("sum", F.col("p"))}
    out = salted_aggregate(calls, ["site_key"], sums, ["row_id"])
    return out.select("site_key", "coverage", "n_modified", F.round("s", 6).alias("prob_1_sum"))


def p4_read_results(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls").select("row_id", "readname", _probability().alias("p"))
    sums = {"n_rows": ("count", F.lit(1)), "n": ("count", F.col("p")), "s": ("sum", F.col("p")), "q": ("sum", F.col("p") * F.col("p"))}
    out = salted_aggregate(calls, ["readname"], sums, ["row_id"])
    mean = F.try_divide(F.col("s"), F.col("n"))
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("q"), F.col("n")) - mean * mean))
    return out.select("readname", "n_rows", F.round(mean + 1e-9, 5).alias("prob_1_mean"), F.round(F.when(F.col("n") > 0, deviation + 1e-9), 5).alias("prob_1_deviation"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected_lines(table(spark, d, "feature_lines"))


def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    return valid_rows(table(spark, d, "feature_lines"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return reject_counts(table(spark, d, "feature_lines"))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows with each list as the sum of its numbers."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    rows = valid_rows(table(spark, d, "feature_lines"))
    sums = [F.round(total(F.col(c)), 5).alias(f"{c}_sum") for c in ("signal_means", "signal_stds", "signal_lens")]
    return rows.select("line_no", "file_name", "chrom", "pos", "strand", "readname", "k_mer", *sums, F.round(total(F.flatten("raw_signals")), 4).alias("raw_signals_sum"), "methy_label", "tag", "gc_content")


QUERIES: dict[str, Query] = {q.__name__: q for q in (p1_found, p1_reasons, p3_found, p3_profile, p4_found, p4_site_results, p4_read_results, p6_found, p6_rows, p6_report, p6_values)}

_VALUES = """v as (
  select load_id, 'prob_1' as col_name, prob_1 is null as is_null, case when prob_1 between 0 and 1 and not isnan(prob_1) then prob_1 + 0.0 end as num,
    null::varchar as txt, case when prob_1 between 0 and 1 and not isnan(prob_1) then least(floor(prob_1 * 10), 9)::int::varchar end as part from calls
  union all select load_id, 'called_label', called_label is null, case when called_label in (0, 1) then called_label::double end, null, case when called_label in (0, 1) then called_label::varchar end from calls
  union all select load_id, 'strand', strand is null, null, case when strand in ('+', '-', '.') then strand end, case when strand in ('+', '-', '.') then strand end from calls
),
s as (select load_id, col_name, count(*) as n_rows, count(*) filter (is_null) as n_null, count(part) as n_good, count(*) filter (not is_null and part is null) as n_violation,
  count(distinct coalesce(num::varchar, txt)) as n_distinct, min(num) as min_num, max(num) as max_num, min(txt) as min_txt, max(txt) as max_txt from v where load_id is not null group by 1, 2),
pairs as (select load_id, col_name, n_good, lag(load_id) over w as before_id, lag(n_good) over w as n_before from s window w as (partition by col_name order by load_id)),
shares as (select v.load_id, v.col_name, v.part, count(*) / max(s.n_good)::double as share from v join s using (load_id, col_name) where part is not null group by 1, 2, 3),
signed as (
  select p.load_id, p.col_name, h.part, h.share from pairs p join shares h using (load_id, col_name) where p.n_good > 0 and p.n_before > 0
  union all select p.load_id, p.col_name, h.part, -h.share from pairs p join shares h on h.load_id = p.before_id and h.col_name = p.col_name where p.n_good > 0 and p.n_before > 0
),
moved as (select load_id, col_name, sum(abs(d)) / 2 as moved_share from (select load_id, col_name, part, sum(share) as d from signed group by 1, 2, 3) group by 1, 2)"""

_LINES = r"""t as (select line_no, file_name, regexp_replace(coalesce(line_text, ''), '^[ \t\r]+|[ \t\r]+$', '', 'g') as x from feature_lines),
q as (select line_no, file_name, x, contains(x, '"') and not regexp_full_match(x, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') as bad_quote from t),
f as (select line_no, file_name, x, bad_quote, list_transform(regexp_extract_all(x || chr(9), '(?s)("(?:[^"]|"")*"|[^\t"]*)\t', 1), lambda e: case when starts_with(e, '"') then replace(substr(e, 2, length(e) - 2), '""', '"') else e end) as c from q),
n as (select *, x = '' or len(c) not in (13, 14) as bad_count from f),
b as (select *, case when bad_quote or bad_count then false else not (
  len(string_split(c[8], ',')) = 21 and len(string_split(c[9], ',')) = 21 and regexp_full_match(c[10], '[0-9]+(?:,[0-9]+){20}')
  and len(string_split(c[11], ';')) = 21 and len(list_filter(string_split(c[11], ';'), lambda e: len(string_split(e, ',')) <> 15)) = 0
  and len(list_filter(string_split(replace(c[8] || ',' || c[9] || ',' || c[11], ';', ','), ','), lambda e: not (regexp_full_match(e, '[+-]?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?') and coalesce(isfinite(try_cast(e as double)), false)))) = 0
  and c[12] in ('0', '1') and c[13] in ('0', '1')) end as bad_value from n)"""

_FLAT = r"""f as (select row_id, nullif(nullif(lower(regexp_extract(readname, '^\s*@?\s*([^\s@]\S*)', 1)), ''), '.') as src, signal_means, signal_stds, signal_lens, raw_signals from features where readname is not null),
flat as (
  select row_id, src, 'signal_means' as field_name, generate_subscripts(signal_means, 1) - 1 as base_idx, unnest(signal_means) as v from f where src is not null
  union all select row_id, src, 'signal_stds', generate_subscripts(signal_stds, 1) - 1, unnest(signal_stds) from f where src is not null
),
starts as (select *, case when v = lag(v) over w then 0 else 1 end as s from flat window w as (partition by row_id, field_name order by base_idx)),
runs as (select *, sum(s) over (partition by row_id, field_name order by base_idx) as run from starts),
sized as (select *, count(*) over (partition by row_id, field_name, run) >= 5 and v is not null as stuck from runs),
bases as (select row_id, src, generate_subscripts(raw_signals, 1) - 1 as base_idx, unnest(raw_signals) as r, unnest(signal_lens) as n from f where src is not null),
placed as (select row_id, src, base_idx, r, (len(r) - least(n, len(r))) // 2 as first_at, least(n, len(r)) as n from bases),
samples as (select row_id, src, base_idx, first_at, n, generate_subscripts(r, 1) - 1 as place, unnest(r) as v from placed),
kept as (select *, place >= first_at and place < first_at + n as there from samples),
whole as (select row_id, src, base_idx, count(*) filter (there) >= 5 and min(v) filter (there) = max(v) filter (there) and bool_and(isfinite(v)) filter (there) as stuck, median(v) filter (there and isfinite(v)) as level,
  max(v) filter (place = 7 and there and isfinite(v)) - max(v) filter (place = 6 and there and isfinite(v)) as step from kept group by 1, 2, 3),
step1 as (select *, isfinite(v) and not stuck and not (field_name = 'signal_stds' and v < 0) as good from sized),
cells as (
  select row_id, src, field_name, v, case when good and lag(good) over w then abs(v - lag(v) over w) end as step, good from step1 window w as (partition by row_id, field_name order by base_idx)
  union all select row_id, src, 'raw_signals', level, case when not stuck then abs(step) end, level is not null and not coalesce(stuck, false) from whole
),
quartiles as (select src, field_name, median(v) filter (good) as c, (quantile_cont(v, 0.75) filter (good) - quantile_cont(v, 0.25) filter (good)) / 1.349 as s from cells group by 1, 2),
usual as (select src, field_name, avg(step) * 2 / 1.349 as step from (select row_id, src, field_name, median(step) as step from cells group by 1, 2, 3) group by 1, 2),
model as (select src, field_name, c, s, coalesce(greatest(0.3, least(0.9, 1 - (1 - step * step / (2 * s * s)) / 0.5)), 0.5) as noise from quartiles join usual using (src, field_name)),
series as (
  select row_id, src, field_name, base_idx as spot, base_idx, v, v is not null and isfinite(v) and not (field_name = 'signal_stds' and v < 0) as ok from flat
  union all select row_id, src, 'raw_signals', base_idx * 15 + place, base_idx, v, there and isfinite(v) from kept
),
listed as (select row_id, field_name, any_value(c) as c, any_value(s) as s, any_value(noise) as noise, list(v order by spot) as v, list(ok order by spot) as ok, max(spot) as last_at from series join model using (src, field_name) where s > 0 group by 1, 2),
filtered as (
  select row_id, field_name, -1::bigint as spot, 0.0::double as level, (1 - noise)::double as spread, false as flag from listed
  union all
  select row_id, field_name, spot, ahead + case when ok and not flag then w / total * (u - ahead) else 0 end, w * (1 - case when ok and not flag then w / total else 0 end), flag from (
    select *, ok and (u - ahead) * (u - ahead) > 36.0::double * total as flag from (
      select k.row_id, k.field_name, k.spot + 1 as spot, 0.5::double * k.level as ahead, 0.25::double * k.spread + 0.75::double * (1 - l.noise) as w, 0.25::double * k.spread + 0.75::double * (1 - l.noise) + l.noise as total,
        l.ok[k.spot + 2] as ok, case when l.ok[k.spot + 2] then (l.v[k.spot + 2] - l.c) / l.s else 0 end as u
      from filtered k join listed l on l.row_id = k.row_id and l.field_name = k.field_name where k.spot < l.last_at))
)"""

ORACLES: dict[str, str] = {
    "p1_reasons": f"""with recursive {_FLAT}, flags as (
  select row_id, field_name, base_idx, 'impossible' as reason from flat where not isfinite(v) or (field_name = 'signal_stds' and v < 0)
  union all select row_id, field_name, base_idx, 'stuck' from sized where stuck
  union all select distinct row_id, 'raw_signals', base_idx, 'impossible' from kept where there and not isfinite(v)
  union all select row_id, 'raw_signals', base_idx, 'stuck' from whole where stuck
  union all select distinct row_id, field_name, case when field_name = 'raw_signals' then spot // 15 else spot end, 'spike' from filtered where flag
)
select row_id, field_name, reason, count(*) as n_bases from flags group by 1, 2, 3""",
    "p3_found": f"""with {_VALUES}
select load_id, col_name, 'null_rate' as issue_kind from s where n_null > 0.05 * n_rows
union all select load_id, col_name, 'violation' from s where n_violation > 0.03 * n_rows
union all select load_id, col_name, 'drift' from moved where round(moved_share, 9) > 0.2""",
    "p3_profile": f"""with {_VALUES},
ranked as (select load_id, col_name, num, row_number() over (partition by load_id, col_name order by num) as r, count(*) over (partition by load_id, col_name) as n from v where num is not null and load_id is not null),
q as (select load_id, col_name, min(num) filter (r >= ceil(0.25 * n)) as q25, min(num) filter (r >= ceil(0.5 * n)) as q50, min(num) filter (r >= ceil(0.75 * n)) as q75 from ranked group by 1, 2),
c as (select load_id, col_name, coalesce(num::varchar, '') || coalesce(txt, '') as k, num, txt, count(*) as n from v where part is not null and load_id is not null group by all),
steps as (
  select p.load_id, p.col_name, c.num, c.txt, c.n / p.n_good::double as d from pairs p join c using (load_id, col_name) where p.n_good > 0 and p.n_before > 0
  union all select p.load_id, p.col_name, c.num, c.txt, -c.n / p.n_before::double from pairs p join c on c.load_id = p.before_id and c.col_name = p.col_name where p.n_good > 0 and p.n_before > 0
),
curve as (select load_id, col_name, sum(sum(d)) over (partition by load_id, col_name order by num, txt) as f from steps group by load_id, col_name, num, txt),
ks as (select load_id, col_name, max(abs(f)) as ks from curve group by 1, 2)
select s.load_id, s.col_name, s.n_rows, s.n_null, s.n_violation, s.n_distinct, round(min_num, 6) as min_num, round(max_num, 6) as max_num, min_txt, max_txt, q25, q50, q75, round(ks, 6) as ks, round(moved_share, 6) as moved_share
from s left join q using (load_id, col_name) left join ks using (load_id, col_name) left join moved using (load_id, col_name)""",
    "p4_found": """with t as (select count(*) as n from calls)
select 'site' as key_kind, chrom || '||' || pos as key_value from calls where chrom is not null and pos is not null group by 2 having count(*) * 100 >= (select n from t)
union all select 'read', readname from calls where readname is not null group by 2 having count(*) * 100 >= (select n from t)""",
    "p4_site_results": """select chrom || '||' || pos as site_key, count(*) as coverage, count(*) filter (called_label = 1) as n_modified,
  round(sum(prob_1) filter (prob_1 between 0 and 1 and not isnan(prob_1)), 6) as prob_1_sum from calls where chrom is not null and pos is not null group by 1""",
    "p4_read_results": """select readname, count(*) as n_rows, round(avg(prob_1) filter (prob_1 between 0 and 1 and not isnan(prob_1)) + 1e-9, 5) as prob_1_mean,
  round(stddev_pop(prob_1) filter (prob_1 between 0 and 1 and not isnan(prob_1)) + 1e-9, 5) as prob_1_deviation from calls where readname is not null group by 1""",
    "p1_found": r"""with f as (select row_id, nullif(nullif(lower(regexp_extract(readname, '^\s*@?\s*([^\s@]\S*)', 1)), ''), '.') as src, signal_means, signal_stds, signal_lens, raw_signals from features where readname is not null),
flat as (
  select row_id, src, 'signal_means' as field_name, generate_subscripts(signal_means, 1) - 1 as base_idx, unnest(signal_means) as v from f where src is not null
  union all select row_id, src, 'signal_stds', generate_subscripts(signal_stds, 1) - 1, unnest(signal_stds) from f where src is not null
),
starts as (select *, case when v = lag(v) over w then 0 else 1 end as s from flat window w as (partition by row_id, field_name order by base_idx)),
runs as (select *, sum(s) over (partition by row_id, field_name order by base_idx) as run from starts),
sized as (select *, count(*) over (partition by row_id, field_name, run) >= 5 and v is not null as stuck from runs),
bases as (select row_id, src, generate_subscripts(raw_signals, 1) - 1 as base_idx, unnest(raw_signals) as r, unnest(signal_lens) as n from f where src is not null),
kept as (select row_id, src, base_idx, list_slice(r, (len(r) - least(n, len(r))) // 2 + 1, (len(r) - least(n, len(r))) // 2 + least(n, len(r))) as r from bases),
judged as (
  select row_id, src, field_name, base_idx, v, stuck from sized
  union all select row_id, src, 'raw_signals', base_idx, unnest(r), len(r) >= 5 and list_min(r) = list_max(r) and isfinite(list_min(r)) from kept
),
good as (select src, field_name, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as c, quantile_cont(v, 0.75) as q3 from judged where isfinite(v) and not stuck and not (field_name = 'signal_stds' and v < 0) group by 1, 2)
select distinct row_id, field_name, base_idx::int as base_idx from judged left join good using (src, field_name)
where stuck or not isfinite(v) or (field_name = 'signal_stds' and v < 0) or (q3 > q1 and abs(v - c) > 8 * (q3 - q1) / 1.349)""",
    "p6_found": f"""with {_LINES}
select line_no, case when bad_quote then 'quoting' when bad_count then 'column_count' else 'bad_value' end as reason from b where bad_quote or bad_count or bad_value""",
    "p6_report": f"""with {_LINES}
select file_name, case when bad_quote then 'quoting' when bad_count then 'column_count' when bad_value then 'bad_value' end as reason, count(*) as n_lines from b group by 1, 2""",
    "p6_values": f"""with {_LINES}
select line_no, file_name, c[1] as chrom, case when regexp_full_match(c[2], '[+-]?[0-9]{{1,18}}') then c[2]::bigint end as pos, c[3] as strand, c[5] as readname, c[7] as k_mer,
  round(list_sum(list_transform(string_split(c[8], ','), lambda e: e::double)), 5) as signal_means_sum, round(list_sum(list_transform(string_split(c[9], ','), lambda e: e::double)), 5) as signal_stds_sum,
  round(list_sum(list_transform(string_split(c[10], ','), lambda e: e::double)), 5) as signal_lens_sum, round(list_sum(list_transform(string_split(replace(c[11], ';', ','), ','), lambda e: e::double)), 4) as raw_signals_sum,
  c[12]::int as methy_label, c[13]::int as tag, case when len(c) = 14 then try_cast(c[14] as double) end as gc_content from b where not bad_quote and not bad_count and not bad_value""",
}
