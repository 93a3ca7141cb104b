"""Queries for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import mixing, privacy, sampling, splits, tokens
from strandline.operators.ranks import mixed_sql
from strandline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_groups(table(spark, d, "features"), table(spark, d, "contigs"), table(spark, d, "contig_names"))[0]


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_rows(table(spark, d, "features"), table(spark, d, "contigs"), table(spark, d, "contig_names"))


def p2_forest(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the spanning forest."""
    return splits.related_groups(table(spark, d, "features"), table(spark, d, "contigs"), table(spark, d, "contig_names"))[1].edges


def p2_split_report(spark: SparkSession, d: str) -> DataFrame:
    """Of the dealt rows: all of them, their groups, groups in several splits, and whether each split has its share within one percent."""
    rows = splits.split_report(p2_split(spark, d))
    near = F.abs(F.col("share") - F.col("target_share")) <= 0.01
    return rows.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_groups").alias("n_groups"), F.sum("n_mixed_groups").alias("n_mixed_groups"), F.bool_and(near).alias("shares_met"))


def p2_forest_report(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, groups and edges of the forest."""
    return splits.forest_report(splits.related_groups(table(spark, d, "features"), table(spark, d, "contigs"), table(spark, d, "contig_names"))[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.unmet(table(spark, d, "features"), table(spark, d, "sample_targets"))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(table(spark, d, "features"), table(spark, d, "sample_targets"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.report(table(spark, d, "features"), table(spark, d, "sample_targets"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Per language, the documents whose ids decode to their text again, and the tokens of all of them."""
    documents = table(spark, d, "documents").select("doc_id", "lang", "text")
    ids = tokens.encode(documents)
    back = tokens.decode(ids).withColumnRenamed("text", "decoded")
    joined = documents.join(ids, "doc_id").join(back, "doc_id")
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(same.cast("int")).alias("n_same"), F.sum(F.size("ids")).alias("n_tokens"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares_everything(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a mix of as many tokens as the sources hold in one pass: scarce sources reach their repeats and come out unmet."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"), everything=True)


def p8_mix_report(spark: SparkSession, d: str) -> DataFrame:
    """What the mix keeps to: a place for every copy, no copy twice, repeats within their bounds, shards of one size but for whole documents."""
    targets = table(spark, d, "mix_targets").where("source is not null").groupBy("source").agg(F.max("max_repeats").alias("max_repeats"))
    mixed = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    shards = mixed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"), F.countDistinct("place").alias("places"))
    copies = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repeat_no").alias("repeats")).join(F.broadcast(targets), "source", "left")
    placed = shards.agg(F.sum("n").alias("n_copies"), F.count_if((F.col("n") != F.col("last")) | (F.col("n") != F.col("places"))).alias("n_bad_shards"))
    counted = copies.agg(F.count_if(F.col("n") != F.col("repeats")).alias("n_twice"), F.count_if(~(F.col("n") <= F.col("max_repeats"))).alias("n_over_repeats"), F.sum("n").alias("n_in_sources"))
    return placed.join(F.broadcast(counted)).select((F.col("n_copies") == F.col("n_in_sources")).alias("is_whole"), "n_bad_shards", "n_twice", "n_over_repeats")  # one row each


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return privacy.find(table(spark, d, "documents"), table(spark, d, "name_parts")).select("doc_id", "pii_kind", "pii_text").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return privacy.redact(table(spark, d, "documents"), table(spark, d, "name_parts"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (p2_found, p2_split, p2_forest, p2_split_report, p2_forest_report, p5_found, p5_sample, p5_report, p7_ids, p7_round_trip, p8_mix, p8_shares, p8_shares_everything, p8_mix_report, p9_found, p9_redacted)}

_GROUPS = r"""names as (select lower(trim(contig)) as spelling, contig, 0 as k from contigs union all select lower(trim(alias_name)), contig, 1 from contig_names),
known as (select spelling, arg_min(contig, (k, contig)) as contig from names group by 1),
f as (select row_id, nullif(nullif(lower(regexp_extract(readname, '^\s*@?\s*([^\s@]\S*)', 1)), ''), '.') as r, nullif(nullif(lower(regexp_replace(chrom, '^\s+|\s+$', '', 'g')), ''), '.') as spelling from features),
k as (select row_id, r, coalesce(contig, f.spelling) as c from f left join known using (spelling)),
links as (select distinct 'r' || r as u, 'c' || c as v from k where r is not null and c is not null),
e as (select u, v from links union select v, u from links),
n as (select 'r' || r as node from k where r is not null union select 'c' || c from k where c is not null),
reach as (select node, node as other from n union select e.v, reach.other from reach join e on e.u = reach.node),
g as (select node, coalesce(min(substr(other, 2)) filter (starts_with(other, 'c')), min(substr(other, 2)) filter (starts_with(other, 'r'))) as group_key from reach group by 1)"""
_POPULATION = "p as (select row_id, upper(substr(k_mer, 9, 5)) as k_mer5, methy_label from features where regexp_full_match(k_mer, '[A-Za-z]{21}') and methy_label in (0, 1))"
_DRAWN = f"""{_POPULATION},
n as (select count(*) as n, count(*) // 10 as size from p),
w as (select k_mer5, methy_label, sum(target_share) as t, max(min_rows) as least from sample_targets group by 1, 2),
k as (select *, row_number() over (partition by k_mer5, methy_label order by {mixed_sql("row_id", 5)}, row_id) as rank from p),
e as (select k.*, t, (rank - 0.5) / t as priority, rank > least as beyond from k join w using (k_mer5, methy_label) where rank <= least or t > 0),
d as (select * from e qualify row_number() over (order by beyond, priority, k_mer5, methy_label, rank) <= (select size from n))"""

ORACLES: dict[str, str] = {
    "p5_found": """with p as (select upper(substr(k_mer, 9, 5)) as k_mer5, methy_label from features where regexp_full_match(k_mer, '[A-Za-z]{21}') and methy_label in (0, 1)),
c as (select k_mer5, methy_label, count(*) as n from p group by 1, 2)
select t.k_mer5, t.methy_label from sample_targets t left join c using (k_mer5, methy_label)
where coalesce(n, 0) < greatest(t.min_rows, ceil(t.target_share::decimal(18, 9) * ((select count(*) from p) // 10)::decimal(18, 0)))""",
    "p5_sample": f"with {_DRAWN} select row_id, k_mer5, methy_label, rank, priority from d",
    "p5_report": f"""with {_DRAWN}, c as (select k_mer5, methy_label, count(*) as n_available from p group by 1, 2), g as (select k_mer5, methy_label, count(*) as n_drawn from d group by 1, 2)
select w.k_mer5, w.methy_label, t as target_share, least as min_rows, coalesce(n_available, 0) as n_available, greatest(least, ceil(t::decimal(18, 9) * (select size from n)::decimal(18, 0)))::bigint as n_needed,
  coalesce(n_drawn, 0) as n_drawn, round(coalesce(n_drawn, 0) / (select count(*) from d)::double, 6) as drawn_share, coalesce(n_available, 0) >= greatest(least, ceil(t::decimal(18, 9) * (select size from n)::decimal(18, 0))) as is_met
from w left join c using (k_mer5, methy_label) left join g using (k_mer5, methy_label)""",
    "p8_mix_report": "select true as is_whole, 0::bigint as n_bad_shards, 0::bigint as n_twice, 0::bigint as n_over_repeats from (select count(*) as n from documents)",
    "p2_found": f"""with recursive {_GROUPS}
select row_id, group_key from k join g on g.node = coalesce('c' || c, 'r' || r)""",
    "p2_split_report": f"""with recursive {_GROUPS}
select count(*) as n_rows, count(distinct coalesce(group_key, 'row:' || row_id)) as n_groups, 0::bigint as n_mixed_groups, true as shares_met from k left join g on g.node = coalesce('c' || c, 'r' || r)""",
    "p2_forest_report": f"""with recursive {_GROUPS}
select count(*) as n_nodes, count(distinct group_key) as n_groups, count(*) - count(distinct group_key) as n_edges, 0::bigint as n_lost_edges from g""",
}
