"""Queries over training rows, parsed lines, traces and written output: choosing, mixing, cleaning and shaping rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import arrays, seq, signal
from strandline.functions.hashes import mixed_sql
from strandline.functions.names import read_strand
from strandline.operators import calib, freq, parse_rows, training
from strandline.queries.calls import _O, _P, _V, USABLE, _calls
from strandline.queries.problems import _LINES
from strandline.queries.sequences import _R, _rows
from strandline.session import table

Query = Callable[[SparkSession, str], DataFrame]
CONCAT_CHUNK = 500


# ---- calls and sites


def sites_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Sites with their place in the order of contig and position, counts checked against the coverage."""
    sites = freq.sorted_sites(freq.check_counts(freq.site_counts(_calls(spark, d))))
    return sites.select("place", "chrom", "pos", "coverage", "count_modified")


def calibrated_all(spark: SparkSession, d: str) -> DataFrame:
    """All calls, those that cannot be calibrated as they are."""
    calls = table(spark, d, "calls").select("row_id", "readname", "chrom", "pos", "prob_0", "prob_1", "called_label")
    inside = lambda c: F.col(c).between(0.0, 1.0) & ~F.isnan(c)
    usable = F.col("chrom").isNotNull() & F.col("pos").isNotNull() & F.col("readname").isNotNull() & inside("prob_0") & inside("prob_1") & F.col("called_label").isin(0, 1)
    out = calib.calibrated_all(calls, usable, lambda w: w.withColumn("score", calib.linear_scorer(F.col("probs"), F.col("offsets"), F.col("valid"))))
    return out.select("row_id", F.when(~F.isnan("prob_1"), F.round(F.col("prob_1") + 1e-8, 4)).alias("prob_1"), "called_label")


# ---- training rows


def rows_and_remainder(spark: SparkSession, d: str) -> DataFrame:
    """A third of the rows at random, and the remainder."""
    rows = _rows(spark, d).select("row_id")
    return training.with_choice(rows, rows.count() // 3, seed=3)


def shuffled_concat(spark: SparkSession, d: str) -> DataFrame:
    """Positives and negatives together, shuffled chunk by chunk in proportion."""
    rows = _rows(spark, d)
    return training.shuffled_concat(rows.where("label = 1").select("row_id"), rows.where("label = 0").select("row_id"), CONCAT_CHUNK, seed=4)


def rows_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """All rows in random order over the partitions: as many as before, none twice."""
    return training.shuffled(_rows(spark, d)).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("row_id").alias("n_ids"))


def denoise_once(spark: SparkSession, d: str) -> DataFrame:
    """The rows that one iteration of label cleaning keeps, scored by the k-mers of the other half in two rounds."""
    return training.denoise(_rows(spark, d), training.kmer_scorer, rounds=2, iterations=1).select("row_id", "kmer", "label")


def denoise_balanced(spark: SparkSession, d: str) -> DataFrame:
    """Rows by label after the whole cleaning, negatives chosen by the k-mers of the positives in every iteration."""
    kept = training.denoise(_rows(spark, d), training.kmer_scorer, rounds=2, iterations=4, balance="kmer")
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("kmer").alias("n_kmers"))


def centre_crop(spark: SparkSession, d: str) -> DataFrame:
    """The eleven middle bases of each row."""
    rows = table(spark, d, "features").where("size(signal_lens) = 21 and k_mer rlike '^[A-Za-z]{21}$'")
    lens = arrays.centre_crop(F.col("signal_lens"), 11)
    total = F.aggregate(F.transform(lens, lambda x, i: F.coalesce(x, F.lit(0)).cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("row_id", F.substring("k_mer", 6, 11).alias("k_mer11"), total.alias("len_mix"))


# ---- feature lines


def scoring_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines with at least twelve columns, without one contig, and the numbers in them."""
    rows = parse_rows.scoring_rows(table(spark, d, "feature_lines"), exclude=["chr1"])
    numbers = lambda c: F.size(F.filter(c, lambda x: x.isNotNull()))
    return rows.select("line_no", "chrom", "readname", numbers("signal_means").alias("n_means"), F.size("raw_signals").alias("n_raw"))


def repeated_values(spark: SparkSession, d: str) -> DataFrame:
    """Tag and GC content repeated for each base, and single."""
    rows = parse_rows.valid_rows(table(spark, d, "feature_lines"))
    many, one = parse_rows.with_repeated_values(rows), parse_rows.with_repeated_values(rows, single=True)
    total = F.aggregate("tags", F.lit(0), lambda a, x: a + x).alias("tag_sum")
    size = lambda c, name: F.when(F.col(c).isNotNull(), F.size(c)).alias(name)
    return many.select("line_no", F.size("tags").alias("n_tags"), total, size("gc_contents", "n_gc")).join(one.select("line_no", F.size("tags").alias("n_single")), "line_no")


# ---- traces, segments, contigs


def trace_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Base probabilities of a folded trace: the 64 values of a vector are eight moves of eight columns."""
    rows = table(spark, d, "embeddings").where("size(embedding) = 64")
    moves = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((i == 0) | (F.pmod(i + F.col("vec_id"), F.lit(3)) != 0), 1).otherwise(0))
    values = F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.01)
    trace = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: signal.folded_trace(F.slice(values, i * 8 + 1, F.lit(8))))
    found = rows.select("vec_id", trace.alias("trace"), moves.alias("moves")).select("vec_id", F.posexplode(signal.base_probabilities(F.col("trace"), F.col("moves"))).alias("base", "p"))
    return found.select("vec_id", "base", F.posexplode("p").alias("letter", "share")).withColumn("share", F.round("share", 6))


def segment_places(spark: SparkSession, d: str) -> DataFrame:
    """The segment of an order's lines, laid end to end by quantity, in which a place falls."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("x"))
    placed = lines.select("l_orderkey", F.transform("x", lambda s: s["l_quantity"].cast("int")).alias("lengths"))
    found = placed.select("l_orderkey", arrays.segment_of(F.col("lengths"), F.col("l_orderkey") % 90).alias("s"))
    return found.where("s is not null").select("l_orderkey", "s.segment", F.col("s.offset").cast("bigint").alias("offset"))


def signal_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Ten random samples of each signal in their order."""
    rows = table(spark, d, "embeddings").select("vec_id", signal.sampled(F.transform("embedding", lambda x: x.cast("double")), 10, 7).alias("s"))
    return rows.select("vec_id", F.round(F.aggregate(F.transform("s", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("mix"))


def contig_motifs(spark: SparkSession, d: str) -> DataFrame:
    """Sites of a motif and of a longer piece on both strands of every contig, counted along the strand."""
    contigs = table(spark, d, "contigs").select("contig", F.upper("seq").alias("s"))
    both = contigs.select("contig", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("s")), F.struct(F.lit("-").alias("strand"), seq.reverse_complement(F.col("s")).alias("s")))).alias("x")).select("contig", "x.*")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    sites = both.select("contig", "strand", seq.motif_sites(F.col("s"), ["CG"]).alias("cg"), seq.motif_sites(F.col("s"), ["GATC"], 1).alias("piece"))
    return sites.select("contig", "strand", F.size("cg").alias("n_cg"), total("cg").alias("cg_sum"), F.size("piece").alias("n_piece"), total("piece").alias("piece_sum"))


def strand_of_group(spark: SparkSession, d: str) -> DataFrame:
    """Calls by the strand that a basecall group's name tells; groups are named after the loads' files."""
    group = F.concat(F.lit("BaseCalled_"), F.when(F.col("load_id") % 2 == 0, "template").otherwise("complement"))
    return table(spark, d, "calls").where("load_id is not null").select(read_strand(group).alias("read_strand")).groupBy("read_strand").agg(F.count(F.lit(1)).alias("n_calls"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        sites_sorted, calibrated_all, rows_and_remainder, shuffled_concat, rows_shuffled, denoise_once, denoise_balanced, centre_crop, scoring_rows, repeated_values, trace_probabilities, segment_places, signal_sampled, contig_motifs,
        strand_of_group,
    )
}


def _half(seed: int) -> str:
    return f"row_number() over (order by {mixed_sql('row_id', seed)}, row_id) % 2"


ORACLES: dict[str, str] = {
    "sites_sorted": f"""with {USABLE}, k as (select chrom, pos, count(*) as coverage, count(*) filter (called_label = 1) as count_modified from u where abs(prob_0 - prob_1) >= 0.5 group by 1, 2)
select row_number() over (order by chrom, pos) - 1 as place, chrom, pos, coverage, count_modified from k""",
    "calibrated_all": f"""with {USABLE}, w as (select row_id, {", ".join(f"{p} as p{i}, {v} / (1 + least({o} / 1000, 10)) as w{i}" for i, (p, o, v) in enumerate(zip(_P, _O, _V)))} from u),
s as (select row_id, round(({" + ".join(f"p{i} * w{i}" for i in range(11))}) / ({" + ".join(f"w{i}" for i in range(11))}), 6) as p from w)
select c.row_id, case when p is not null then round(p + 1e-8, 4) when not isnan(prob_1) then round(prob_1 + 1e-8, 4) end as prob_1, case when p is not null then (p >= 0.5)::int else called_label end as called_label from calls c left join s using (row_id)""",
    "rows_and_remainder": f"with {_R} select row_id, row_number() over (order by {mixed_sql('row_id', 3)}, row_id) <= (select count(*) // 3 from r) as chosen from r",
    "shuffled_concat": f"""with {_R}, n as (select count(*) filter (label = 1) as n, count(*) filter (label = 0) as m from r),
a as (select row_id, label, row_number() over (partition by label order by row_id) - 1 as k from r),
c as (select row_id, floor(k / case when label = 1 then {CONCAT_CHUNK} else round_even((select m / n::double from n) * {CONCAT_CHUNK}, 0) + 1 end)::bigint as chunk from a)
select row_id, chunk, row_number() over (order by chunk, {mixed_sql('row_id', 4)}, row_id) - 1 as place from c""",
    "rows_shuffled": f"with {_R} select count(*) as n_rows, count(distinct row_id) as n_ids from r",
    "denoise_once": f"""with {_R}, h as (select *, {_half(1)} as h1, {_half(2)} as h2 from r),
s1 as (select h1, kmer, (count(*) filter (label = 1) + 1) / (count(*) + 2)::double as p from h group by 1, 2), s2 as (select h2, kmer, (count(*) filter (label = 1) + 1) / (count(*) + 2)::double as p from h group by 1, 2),
m as (select row_id, h.kmer, label, (coalesce(s1.p, 0.5::double) + coalesce(s2.p, 0.5::double)) / 2 as p from h left join s1 on s1.h1 = 1 - h.h1 and s1.kmer = h.kmer left join s2 on s2.h2 = 1 - h.h2 and s2.kmer = h.kmer)
select row_id, kmer, label from m where case when label = 1 then p >= 0.5 else p < 0.5 end""",
    "centre_crop": """with f as (select row_id, k_mer, list_slice(signal_lens, 6, 16) as l from features where len(signal_lens) = 21 and regexp_full_match(k_mer, '[A-Za-z]{21}'))
select row_id, substr(k_mer, 6, 11) as k_mer11, list_sum(list_transform(l, lambda x, i: coalesce(x, 0)::bigint * i))::bigint as len_mix from f""",
    "scoring_rows": r"""with t as (select line_no, string_split(regexp_replace(line_text, '[ \t\n\x0B\f\r]+$', ''), chr(9)) as c from feature_lines where line_text is not null)
select line_no, c[1] as chrom, c[5] as readname, len(list_filter(string_split(c[8], ','), lambda e: regexp_full_match(trim(e), '(?i)[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?[df]?|infinity|inf|nan)')))::int as n_means, len(string_split(c[11], ';'))::int as n_raw
from t where len(c) >= 12 and c[1] <> '' and c[1] <> 'chr1'""",
    "repeated_values": f"""with {_LINES} select line_no, 21 as n_tags, 21 * c[13]::int as tag_sum, case when len(c) = 14 and try_cast(c[14] as double) is not null then 21 end as n_gc, 1 as n_single from b where not bad_quote and not bad_count and not bad_value""",
    "trace_probabilities": """with x as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, abs(unnest(embedding)::double) + 0.01 as v from embeddings where len(embedding) = 64),
t as (select vec_id, i // 8 as move, i % 4 as letter, sum(v) as v from x group by 1, 2, 3),
g as (select *, count(*) filter (move = 0 or (move + vec_id) % 3 <> 0) over (partition by vec_id, letter order by move) - 1 as base from t),
b as (select vec_id, base, letter, sum(v) as v from g group by 1, 2, 3)
select vec_id, base::int as base, letter::int as letter, round(v / sum(v) over (partition by vec_id, base), 6) as share from b""",
    "segment_places": """with l as (select l_orderkey, row_number() over w - 1 as segment, l_quantity::int as n, coalesce(sum(l_quantity::int) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and 1 preceding), 0) as start
  from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity))
select l_orderkey, segment::int as segment, (l_orderkey % 90 - start)::bigint as offset from l where l_orderkey % 90 >= start and l_orderkey % 90 < start + n""",
    "signal_sampled": f"""with x as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v from embeddings),
k as (select * from x qualify row_number() over (partition by vec_id order by {mixed_sql('i::bigint', 7)}, i) <= 10)
select vec_id, round(sum(v * k), 4) as mix from (select vec_id, v, row_number() over (partition by vec_id order by i) as k from k) group by 1""",
    "contig_motifs": """with b as (select contig, '+' as strand, upper(seq) as s from contigs union all select contig, '-', translate(reverse(upper(seq)), 'ACGT', 'TGCA') from contigs),
p as (select contig, strand, string_split(s, 'CG') as c, string_split(s, 'GATC') as g from b),
lc as (select contig, strand, generate_subscripts(c, 1) as i, length(unnest(c)) as k, len(c) as n from p), lg as (select contig, strand, generate_subscripts(g, 1) as i, length(unnest(g)) as k, len(g) as n from p),
sc as (select contig, strand, sum(k + 2) over (partition by contig, strand order by i) - 2 as at_place, i, n from lc), sg as (select contig, strand, sum(k + 4) over (partition by contig, strand order by i) - 4 + 1 as at_place, i, n from lg),
a as (select contig, strand, count(*) filter (i < n)::int as n_cg, coalesce(sum(at_place) filter (i < n), 0)::bigint as cg_sum from sc group by 1, 2), e as (select contig, strand, count(*) filter (i < n)::int as n_piece, coalesce(sum(at_place) filter (i < n), 0)::bigint as piece_sum from sg group by 1, 2)
select * from a join e using (contig, strand)""",
    "strand_of_group": "select case when load_id % 2 = 0 then 't' else 'c' end as read_strand, count(*) as n_calls from calls where load_id is not null group by 1",
}
