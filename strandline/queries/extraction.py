"""Queries of the pipeline from signals and alignments to feature rows and tagged reads.

No alignments are given, so every vector stands for the signal of a read: its letters are those of a stretch of a contig, its
CIGAR, flags and trimming follow from its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import cigar, seq
from strandline.operators import filters
from strandline.plans import extract
from strandline.session import spread, table
from strandline.sources import sam

Query = Callable[[SparkSession, str], DataFrame]
MOVES = 28
SETTINGS = extract.Settings(motifs="CG,CA,CT", kmer=5, samples=3, mapq=1, fraction=0.8, identity=0.85, exclude=("none",))


def _reads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Signals and alignments."""
    v = F.col("vec_id")
    contigs = table(spark, d, "contigs").select("contig", "seq", "length", F.row_number().over(Window.orderBy("contig")).alias("k"))  # a fixed, small table
    n_contigs = contigs.count()
    moves = F.transform(F.sequence(F.lit(0), F.lit(MOVES - 1)), lambda i: F.when((i == 0) | (F.pmod(i * 7 + v, F.lit(3)) != 0), 1).otherwise(0))
    rows = spread(table(spark, d, "embeddings").select("vec_id", "embedding")).withColumn("k", v % n_contigs + 1).join(F.broadcast(contigs), "k").withColumn("moves", moves)
    n = F.aggregate("moves", F.lit(0), lambda a, m: a + m)
    start = v * 37 % (F.col("length") - 64)
    rows = rows.withColumns({"n": n, "start": start}).withColumn("letters", F.upper(F.substring("seq", (F.col("start") + 1).cast("int"), F.col("n"))))
    flag = F.when(v % 13 == 12, 256).when(v % 11 == 10, 4).when(v % 4 == 0, 16).otherwise(0)
    a, b, c, e, x = v % 3, 3 + v % 5, v % 2, 2 + v % 4, v % 3
    step = lambda size, letter: F.when(size > 0, F.concat(size.cast("string"), F.lit(letter))).otherwise("")
    text = F.concat(step(a, "S"), step(b, "M"), step(c, "I"), step(e, "M"), step(x, "D"), step(F.col("n") - a - b - c - e, "M"))
    read_id = F.concat(F.lit("r"), v)
    signals = rows.select(read_id.alias("read_id"), F.transform("embedding", lambda s: s.cast("double")).alias("signal"))
    aligned = rows.select(
        read_id.alias("read_id"), flag.alias("flag"), (v % 7).cast("int").alias("mapq"), F.col("contig").alias("ref_name"), F.col("start").alias("ref_start"), text.alias("cigar"),
        F.when(flag == 16, seq.reverse_complement(F.col("letters"))).otherwise(F.col("letters")).alias("seq"), F.lit(2).alias("stride"), "moves", (v % 5 - 1).cast("int").alias("ts"), F.lit(None).cast("int").alias("sp"), (v % 4).cast("int").alias("nm"),
    )
    return signals, aligned


def _weighted(values: Column) -> Column:
    return F.round(F.aggregate(F.transform(values, lambda x, i: F.nanvl(x.cast("double"), F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4)


def extract_features(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows; arrays as sums weighted by place."""
    rows = extract.features(*_reads(spark, d), SETTINGS, reference=table(spark, d, "contigs"))
    mixes = [_weighted(F.col(c)).alias(f"{c}_mix") for c in ("signal_means", "signal_stds", "signal_lens")]
    return rows.select("chrom", "pos", "strand", "pos_in_strand", "readname", "loc", "k_mer", *mixes, _weighted(F.flatten("raw_signals")).alias("raw_signals_mix"), "tag")


def extract_at_positions(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows at listed positions: every seventh place of the contigs' CpGs, either strand."""
    listed = table(spark, d, "positions").select("chrom", "pos", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"))
    rows = extract.features(*_reads(spark, d), SETTINGS, positions=listed)
    return rows.select("chrom", "pos", "strand", "readname", "loc")


def read_status(spark: SparkSession, d: str) -> DataFrame:
    """How many reads pass, and which filter holds back the others."""
    return extract.prepared_reads(*_reads(spark, d), SETTINGS).groupBy("status").agg(F.count(F.lit(1)).alias("n_reads"))


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    reads = extract.prepared_reads(*_reads(spark, d), SETTINGS)
    sites = extract.site_windows(reads, SETTINGS)
    number = F.substring("read_id", 2, 20).cast("bigint") * 7919 + F.col("loc") * 104729
    return extract.tagged_reads(reads, sites.select("read_id", "loc", (number % 1000001 / 1e6).alias("prob_1")))


def tagged_reads(spark: SparkSession, d: str) -> DataFrame:
    """The modification tags of every read; reads without sites stay."""
    return _tagged(spark, d).select("read_id", "mm", F.array_join(F.transform("ml", lambda x: x.cast("string")), ",").alias("ml"))


def tagged_sam(spark: SparkSession, d: str) -> DataFrame:
    """SAM lines of the tagged reads with their place in the order of contig and position."""
    lines = sam.sam_lines(_tagged(spark, d))
    return lines.select("line")


def cigar_lift_reads(spark: SparkSession, d: str) -> DataFrame:
    """Each mapped read's lifted places as a sum weighted by letter, over as many CIGARs as the reads have."""
    mapped = _reads(spark, d)[1].where(~filters.is_unmapped(F.col("flag")))
    places = cigar.query_to_reference(F.col("cigar"), filters.is_reverse(F.col("flag")))
    back = cigar.reference_to_query(F.col("cigar"), filters.is_reverse(F.col("flag")))
    rows = mapped.select("read_id", "cigar", places.alias("places"), back.alias("back"))
    total = lambda a: F.aggregate(F.transform(a, lambda x, i: (x * (i + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select("read_id", "cigar", F.size("places").alias("n_places"), total("places").alias("place_mix"), F.size("back").alias("n_back"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (extract_features, extract_at_positions, read_status, tagged_reads, tagged_sam, cigar_lift_reads)}

_E = """c as (select contig, upper(seq) as seq, length, row_number() over (order by contig) as k from contigs),
mv as (select vec_id, i, row_number() over (partition by vec_id order by i) - 1 as base, coalesce(lead(i) over (partition by vec_id order by i), 28) as stop from embeddings, (select unnest(range(28)) as i) where i = 0 or (i * 7 + vec_id) % 3 <> 0),
nb as (select vec_id, count(*) as n from mv group by 1),
r as (select vec_id, n, contig, length, (vec_id * 37) % (length - 64) as start, case when vec_id % 13 = 12 then 256 when vec_id % 11 = 10 then 4 when vec_id % 4 = 0 then 16 else 0 end as flag, vec_id % 7 as mapq, vec_id % 4 as nm,
  vec_id % 3 as a, 3 + vec_id % 5 as b, vec_id % 2 as ins, 2 + vec_id % 4 as e, vec_id % 3 as x, substr(seq, ((vec_id * 37) % (length - 64) + 1)::bigint, n) as letters, embedding, vec_id % 5 - 1 as ts
  from embeddings join nb using (vec_id) join c on c.k = vec_id % (select count(*) from contigs) + 1),
s as (select *, case when flag = 256 then 'secondary' when mapq < 1 then 'low_mapq' when flag <> 4 and (n - a) / n::double < 0.8 then 'low_coverage' when flag <> 4 and 1 - nm / (n - a)::double < 0.85 then 'low_identity' else 'ok' end as status from r),
ok as (select * from s where status = 'ok'),
p as (select vec_id, unnest(range(0, n - 1)) as loc from ok),
site as (select p.vec_id, loc, loc - lag(loc) over w as before, lead(loc) over w - loc as behind from p join ok using (vec_id) where substr(letters, loc + 1, 2) in ('CG', 'CA', 'CT') window w as (partition by p.vec_id order by loc)),
l as (select site.*, ok.*, n - a - b - ins - e as f, case when flag = 16 then loc else loc - a end as j from site join ok using (vec_id)),
q as (select *, case when flag = 4 then 0 when j < 0 or j >= n - a then -1 when flag = 16 then case when j < f then j when j < f + e then j + x when j < f + e + ins then -1 else j + x - ins end
  else case when j < b then j when j < b + ins then -1 when j < b + ins + e then j - ins else j - ins + x end end as rpos from l),
kept as (select *, case when flag = 4 then '.' else contig end as chrom, case when flag = 4 then -1 when flag = 16 then start + b + e + x + f - 1 - rpos else start + rpos end as pos, case when flag = 4 then '.' when flag = 16 then '-' else '+' end as strand,
  (coalesce(before, 99) <= 10 or coalesce(behind, 99) <= 10)::int as tag from q where rpos >= 0 and loc >= 2 and loc < n - 2)"""

_SAMPLES = """v as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as v, ts from ok),
t as (select vec_id, case when ts >= 0 then i - ts else i end as i, v from v where case when ts >= 0 then i >= ts else i < 64 + ts end),
md as (select vec_id, median(v) as m from t group by 1),
sc as (select vec_id, m, median(abs(v - m)) / 0.6744897501960817 as s from t join md using (vec_id) group by 1, 2),
z as (select vec_id, i, case when s = 0 then v else (v - m) / s end as z from t join sc using (vec_id)),
g as (select mv.vec_id, base, z, row_number() over (partition by mv.vec_id, base order by z.i) - 1 as k, count(*) over (partition by mv.vec_id, base) as n from mv join z on z.vec_id = mv.vec_id and z.i >= mv.i * 2 and z.i < mv.stop * 2),
st as (select vec_id, base, avg(z) as m, stddev_pop(z) as d, count(*) as n from g group by 1, 2),
rect as (select vec_id, base, z, (3 - n) // 2 + k as place from g where n <= 3 union all select g.vec_id, base, z, t.t from g join (select unnest([0, 1, 2]) as t) t on g.k = floor(t.t * (g.n - 1) / 2.0)::int where g.n > 3)"""

ORACLES: dict[str, str] = {
    "extract_features": f"""with {_E}, {_SAMPLES},
w as (select kept.vec_id, loc, sum((base - loc + 3) * st.m) as means, sum((base - loc + 3) * st.d) as stds, sum((base - loc + 3) * st.n)::double as lens from kept join st on st.vec_id = kept.vec_id and st.base between loc - 2 and loc + 2 group by 1, 2),
x as (select kept.vec_id, loc, sum(((base - loc + 2) * 3 + place + 1) * z) as raw from kept join rect on rect.vec_id = kept.vec_id and rect.base between loc - 2 and loc + 2 group by 1, 2)
select chrom, pos::bigint as pos, strand, (case when strand = '-' then length - 1 - pos else pos end)::bigint::varchar as pos_in_strand, 'r' || kept.vec_id as readname, kept.loc::int as loc, substr(letters, (kept.loc - 1)::bigint, 5) as k_mer,
  round(means, 4) as signal_means_mix, round(stds, 4) as signal_stds_mix, round(lens, 4) as signal_lens_mix, round(raw, 4) as raw_signals_mix, tag from kept join w on w.vec_id = kept.vec_id and w.loc = kept.loc join x on x.vec_id = kept.vec_id and x.loc = kept.loc""",
    "extract_at_positions": f"""with {_E} select chrom, pos::bigint as pos, strand, 'r' || vec_id as readname, loc::int as loc from kept where strand <> '.' and exists (select 1 from positions o where o.chrom = kept.chrom and o.pos = kept.pos)""",
    "cigar_lift_reads": f"""with {_E}, y as (select vec_id, n, a, b, ins, e, x, flag, n - a - b - ins - e as f, unnest(range(0, n - a)) as j from r where flag <> 4),
z as (select *, case when flag = 16 then case when j < f then j when j < f + e then j + x when j < f + e + ins then -1 else j + x - ins end else case when j < b then j when j < b + ins then -1 when j < b + ins + e then j - ins else j - ins + x end end as rpos from y)
select 'r' || vec_id as read_id, concat(case when a > 0 then a || 'S' else '' end, b || 'M', case when ins > 0 then ins || 'I' else '' end, e || 'M', case when x > 0 then x || 'D' else '' end, f || 'M') as cigar,
  (n - a + 1)::int as n_places, (sum(rpos * (j + 1)) + (n - a + 1) * (b + e + x + f))::bigint as place_mix, (b + e + x + f)::int as n_back from z group by vec_id, n, a, b, ins, e, x, f""",
    "read_status": f"with {_E} select status, count(*) as n_reads from s group by 1",
    "tagged_reads": f"""with {_E}, cs as (select vec_id, loc, row_number() over (partition by vec_id order by loc) - 1 as k from (select vec_id, unnest(range(0, n)) as loc, letters from ok) where substr(letters, loc + 1, 1) = 'C'),
o as (select kept.vec_id, kept.loc, cs.k - coalesce(lag(cs.k) over (partition by kept.vec_id order by kept.loc), -1) - 1 as skip, least(255, floor((kept.vec_id * 7919 + kept.loc * 104729) % 1000001 / 1e6::double * 256))::int as ml from kept join cs on cs.vec_id = kept.vec_id and cs.loc = kept.loc),
m as (select vec_id, 'C+m?,' || string_agg(skip::varchar, ',' order by loc) || ';' as mm, string_agg(ml::varchar, ',' order by loc) as ml from o group by 1)
select 'r' || ok.vec_id as read_id, mm, ml from ok left join m using (vec_id)""",
}
