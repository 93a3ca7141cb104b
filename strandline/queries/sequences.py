"""Queries over sequences, signals, alignments and training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import arrays, cigar, modtags, seq, signal, vectors
from strandline.operators import filters, training
from strandline.operators.spectrum import spectrum
from strandline.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
CHUNK = 1 << 14


# ---- sequences: letters of the documents' texts stand for nucleotides


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))


_S = """s as (select doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as seq from documents where text is not null),
parts as (select doc_id, seq, string_split(seq, 'CG') as p from s),
lens as (select doc_id, seq, generate_subscripts(p, 1) as i, unnest(p) as part, len(p) as n from parts),
sites as (select doc_id, seq, (sum(length(part) + 2) over (partition by doc_id order by i) - 2)::bigint as spot from lens qualify i < n)"""


def motif_sites(spark: SparkSession, d: str) -> DataFrame:
    found = _sequences(spark, d).select("doc_id", F.explode(seq.motif_sites(F.col("seq"), seq.expand("CG"))).alias("at"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sites"), F.sum(F.col("at").cast("bigint")).alias("at_sum"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def motif_iupac(spark: SparkSession, d: str) -> DataFrame:
    """Sites of CHG, a motif with a set letter, overlaps included."""
    return _sequences(spark, d).select("doc_id", F.size(seq.motif_sites(F.col("seq"), seq.expand("CHG"))).alias("n_sites"))


def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("doc_id", F.md5(seq.reverse_complement(F.col("seq"))).alias("revcomp_md5"))


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("doc_id", "seq", seq.motif_sites(F.col("seq"), ["CG"]).alias("places"))


def proximity_tag(spark: SparkSession, d: str) -> DataFrame:
    """Sites with another one within ten letters."""
    near = _sites(spark, d).select("doc_id", F.size("places").alias("n_sites"), F.aggregate(seq.proximity(F.col("places")), F.lit(0), lambda a, x: a + x).alias("n_near"))
    return near.where("n_sites > 0")


def gc_content(spark: SparkSession, d: str) -> DataFrame:
    shares = _sequences(spark, d).where(F.contains("seq", F.lit("CG"))).select("doc_id", seq.gc_shares(F.col("seq")).alias("gc"))
    return shares.select("doc_id", F.round(F.aggregate("gc", F.lit(0.0), lambda a, x: a + x), 4).alias("gc_sum"))


def mm_skips(spark: SparkSession, d: str) -> DataFrame:
    """Cs skipped between called ones, and whether the tag names the called places again."""
    tagged = _sites(spark, d).where(F.size("places") > 0).withColumn("skips", modtags.skips(F.col("seq"), F.col("places"))).withColumn("mm", modtags.tag_of(F.col("skips")))
    back = tagged.withColumn("back", modtags.called_places(F.col("seq"), F.col("mm")))
    return back.select("doc_id", F.size("places").alias("n_sites"), F.aggregate("skips", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_skipped"), (F.col("back") == F.col("places")).alias("is_same"))


def ml_quantise(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls").where("prob_1 between 0 and 1 and not isnan(prob_1)")
    return calls.select(modtags.ml_tag(F.array("prob_1"))[0].alias("ml")).groupBy("ml").agg(F.count(F.lit(1)).alias("n_calls"))


def contig_cpg(spark: SparkSession, d: str) -> DataFrame:
    """CpG sites of every contig; long contigs are cut into overlapping chunks, so none has to fit one array."""
    pieces = table(spark, d, "contigs").select("contig", F.posexplode(arrays.chunks(F.upper("seq"), CHUNK, 1)).alias("k", "piece"))
    found = pieces.select("contig", "k", F.explode(seq.motif_sites(F.col("piece"), ["CG"])).alias("at"))
    return found.select("contig", (F.col("k").cast("bigint") * CHUNK + F.col("at")).alias("pos"))


def kmer_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of each k-mer, summed with weights by place, and its five middle letters."""
    rows = table(spark, d, "features").where("k_mer rlike '^[A-Z]{21}$'")
    mixed = F.aggregate(F.transform(seq.codes(F.col("k_mer")), lambda c, i: c * (i + 1)), F.lit(0), lambda a, x: a + x)
    return rows.select("row_id", mixed.cast("bigint").alias("code_mix"), seq.centre(F.col("k_mer")).alias("kmer5"))


# ---- signals: the vectors stand for samples, with two samples a move


def _signals(spark: SparkSession, d: str) -> DataFrame:
    moves = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when((i == 0) | (F.pmod(i * 7 + F.col("vec_id"), F.lit(3)) != 0), 1).otherwise(0))
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("signal"), moves.alias("moves"), F.lit(2).alias("stride"))


_G = """x as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings),
g as (select *, count(*) filter (i % 2 = 0 and (i = 0 or ((i // 2) * 7 + vec_id) % 3 <> 0)) over (partition by vec_id order by i) - 1 as base from x where i < 64)"""


def _weighted(values: Column) -> Column:
    return F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def signal_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("vec_id", F.round(_weighted(signal.standardised(F.col("signal"))), 4).alias("mix"))


def signal_mad(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("vec_id", F.round(_weighted(signal.mad_scaled(F.col("signal"))), 4).alias("mix"))


def base_stats(spark: SparkSession, d: str) -> DataFrame:
    """Samples, mean and deviation of every base."""
    groups = _signals(spark, d).select("vec_id", F.posexplode(signal.bases(F.col("signal"), F.col("moves"), F.col("stride"))).alias("base", "g"))
    return groups.select("vec_id", "base", F.size("g").alias("n_samples"), F.round(signal.mean(F.col("g")), 5).alias("mean"), F.round(signal.deviation(F.col("g")), 5).alias("std"))


def signal_rect(spark: SparkSession, d: str) -> DataFrame:
    """Three places for every base, thinned or padded; empty places are left out."""
    rows = _signals(spark, d).select("vec_id", F.posexplode(signal.rectangle(signal.bases(F.col("signal"), F.col("moves"), F.col("stride")), 3)).alias("base", "r"))
    return rows.select("vec_id", "base", F.posexplode("r").alias("place", "value")).where(~F.isnan("value")).withColumn("value", F.round("value", 6))


def signal_picoamps(spark: SparkSession, d: str) -> DataFrame:
    rows = _signals(spark, d).select("vec_id", signal.picoamps(F.col("signal"), F.lit(1400.0) + F.col("vec_id") % 7, F.lit(8192.0), F.lit(10.0)).alias("pa"))
    return rows.select("vec_id", F.round(_weighted(F.col("pa")), 3).alias("mix"))


def signal_trim(spark: SparkSession, d: str) -> DataFrame:
    """Trimmed from the front, or from the tail where the start is negative."""
    start = F.when(F.col("vec_id") % 2 == 0, (F.col("vec_id") % 40).cast("int")).otherwise(-(F.col("vec_id") % 40).cast("int"))
    rows = _signals(spark, d).select("vec_id", signal.trimmed(F.col("signal"), start, F.lit(None).cast("int")).alias("t"))
    return rows.select("vec_id", F.size("t").alias("n_samples"), F.round(signal.total(F.col("t")), 5).alias("total"))


def signal_fft(spark: SparkSession, d: str) -> DataFrame:
    """Magnitude of every frequency of each signal."""
    rows = spectrum(_signals(spark, d), "vec_id", "signal")
    return rows.select("vec_id", F.posexplode("magnitude").alias("k", "m")).select("vec_id", "k", F.round("m", 4).alias("magnitude"))


def infonce_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector with the mean direction of its label."""
    unit = table(spark, d, "embeddings").where("label is not null").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    means = unit.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))
    return table(spark, d, "embeddings").join(centre, "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("centre")), 5).alias("cosine"))


# ---- alignments: orders stand for aligned reads


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    flag = F.when(key % 5 == 0, 16).when(key % 5 == 1, 256).when(key % 5 == 2, 4).otherwise(0)
    text = F.when(key % 4 == 0, "100M").when(key % 4 == 1, "40M5I55M").when(key % 4 == 2, "40M5D60M").otherwise("10S90M")
    rows = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", F.concat(F.lit("r"), F.col("o_custkey") % 500).alias("read_id"), flag.alias("flag"), (F.col("o_custkey") % 60).cast("int").alias("mapq"), (F.col("o_custkey") % 20).cast("int").alias("nm"), text.alias("cigar"))
    start = F.when(key % 4 == 3, 10).otherwise(0)
    return rows.withColumns({"query_length": F.lit(100), "aligned_start": start, "aligned_end": F.lit(100)})


_A = """a as (select o_orderkey, 'r' || (o_custkey % 500) as read_id, case o_orderkey % 5 when 0 then 16 when 1 then 256 when 2 then 4 else 0 end as flag, o_custkey % 60 as mapq, o_custkey % 20 as nm,
  o_orderkey % 4 as kind, case when o_orderkey % 4 = 3 then 90 else 100 end as aligned from orders)"""


def alignment_filters(spark: SparkSession, d: str) -> DataFrame:
    good = filters.good_alignments(_alignments(spark, d), mapq=1, fraction=0.95, identity=0.9)
    return good.groupBy("cigar", "flag").agg(F.count(F.lit(1)).alias("n_reads"))


def pct_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = _alignments(spark, d).select("cigar", F.round(cigar.identity(F.col("cigar")), 6).alias("identity"), cigar.aligned_length(F.col("cigar")).alias("n_aligned"), cigar.reference_length(F.col("cigar")).alias("n_reference"))
    return rows.groupBy("cigar", "identity", "n_aligned", "n_reference").agg(F.count(F.lit(1)).alias("n_reads"))


def cigar_lift(spark: SparkSession, d: str) -> DataFrame:
    """Each read's lifted places, summed with weights by letter, forward or reverse as it is aligned."""
    primary = _alignments(spark, d).where(filters.is_primary(F.col("flag")) & ~filters.is_unmapped(F.col("flag")))
    total = lambda a: F.aggregate(F.transform(a, lambda x, i: (x * (i + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    steps = primary.select("o_orderkey", cigar.stretches(F.col("cigar"), filters.is_reverse(F.col("flag"))).alias("steps"))
    lifted = steps.select("o_orderkey", cigar.places_of(F.col("steps")).alias("places"), cigar.places_back(F.col("steps")).alias("back"))
    return lifted.select("o_orderkey", F.size("places").alias("n_places"), total("places").alias("place_mix"), F.size("back").alias("n_back"))


def signal_alignment_join(spark: SparkSession, d: str) -> DataFrame:
    """Signals with the primary alignments of their read."""
    return _joined(spark, d, _alignments(spark, d))


def signal_alignment_join_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same where every order is a read of its own, so that all signals take part."""
    return _joined(spark, d, _alignments(spark, d).withColumn("read_id", F.concat(F.lit("r"), F.col("o_orderkey"))))


def _joined(spark: SparkSession, d: str, alignments: DataFrame) -> DataFrame:
    signals = table(spark, d, "embeddings").select(F.concat(F.lit("r"), F.col("vec_id")).alias("read_id"), F.size("embedding").alias("n_samples"))
    primary = alignments.where(filters.is_primary(F.col("flag"))).select("read_id", "o_orderkey", "mapq")
    return signals.join(primary, "read_id").groupBy("read_id").agg(F.count(F.lit(1)).alias("n_alignments"), F.max("mapq").alias("best_mapq"), F.max("n_samples").alias("n_samples"))


# ---- training rows: the features


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "features").where("k_mer rlike '^[A-Za-z]{21}$' and methy_label in (0, 1)").select("row_id", F.upper(F.substring("k_mer", 9, 5)).alias("kmer"), F.col("methy_label").alias("label"))


_R = "r as (select row_id, upper(substr(k_mer, 9, 5)) as kmer, methy_label as label from features where regexp_full_match(k_mer, '[A-Za-z]{21}') and methy_label in (0, 1))"


def kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    return training.kmer_counts(_rows(spark, d))


def kmer_quota(spark: SparkSession, d: str) -> DataFrame:
    """How many negatives of each k-mer a balanced choice of 200 takes, those of unmatched k-mers together."""
    return _quota(spark, d, 200)


def kmer_quota_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same of a choice of as many negatives as there are positives."""
    return _quota(spark, d, None)


def _quota(spark: SparkSession, d: str, total: int | None) -> DataFrame:
    rows = _rows(spark, d)
    chosen = training.balanced(rows.where("label = 0"), rows.where("label = 1"), total)
    known = rows.where("label = 1").select("kmer").distinct().withColumn("known", F.lit(True))
    return chosen.join(known, "kmer", "left").groupBy(F.when(F.col("known"), F.col("kmer")).alias("kmer")).agg(F.count(F.lit(1)).alias("n_rows"))


def kmer_sets(spark: SparkSession, d: str) -> DataFrame:
    """K-mers by label: how many rows each label has of them, in one full join."""
    rows = _rows(spark, d)
    side = lambda label, name: rows.where(F.col("label") == label).groupBy("kmer").agg(F.count(F.lit(1)).alias(name))
    both = side(1, "n_pos").join(side(0, "n_neg"), "kmer", "full")
    return both.select("kmer", F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"), F.when(F.col("n_neg").isNull(), "pos").when(F.col("n_pos").isNull(), "neg").otherwise("both").alias("found_in"))


def split_halves(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return training.halves(rows).groupBy("half").agg(F.count(F.lit(1)).alias("n_rows"))


def _scores(rows: DataFrame) -> DataFrame:
    rounds = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("round")
    return rows.select("row_id", rounds).withColumn("prob", F.pmod(F.col("row_id") * 7919 + F.col("round") * 104729, F.lit(1000001)) / 1e6)


def label_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return training.kept_ratio(rows, training.cleaned(rows, _scores(rows)))


def score_means(spark: SparkSession, d: str) -> DataFrame:
    return training.mean_scores(_scores(_rows(spark, d))).select("row_id", F.round("mean_prob", 6).alias("mean_prob"), F.round("std_prob", 6).alias("std_prob"), "n_rounds")


def metrics_classification(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    scored = rows.withColumn("predicted", (F.pmod(F.col("row_id") * 7919, F.lit(1000001)) >= 500000).cast("int"))
    return training.classification(scored)


def metrics_regression(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls").where("prob_1 between 0 and 1 and not isnan(prob_1) and prob_0 between 0 and 1 and not isnan(prob_0)")
    return training.regression(calls.select(F.round("prob_0", 3).alias("y"), F.col("prob_1").alias("p")), "y", "p")


def bce(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "calls").where("prob_1 between 0 and 1 and not isnan(prob_1) and called_label in (0, 1)")
    right = (F.col("prob_1") >= 0.5).cast("int") == F.col("called_label")
    return calls.agg(F.round(F.avg(training.cross_entropy(F.col("called_label"), F.col("prob_1"))), 5).alias("bce"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        motif_sites, motif_iupac, revcomp, proximity_tag, gc_content, mm_skips, ml_quantise, contig_cpg, kmer_codes, signal_zscore, signal_mad, base_stats, signal_rect, signal_picoamps, signal_trim, signal_fft, infonce_cosine,
        alignment_filters, pct_identity, cigar_lift, signal_alignment_join, signal_alignment_join_whole, kmer_counts, kmer_quota, kmer_quota_whole, kmer_sets, split_halves, label_clean, score_means, metrics_classification, metrics_regression, bce,
    )
}

ORACLES: dict[str, str] = {
    "motif_sites": f"with {_S} select doc_id, count(*) as n_sites, sum(spot)::bigint as at_sum, min(spot)::int as first_at, max(spot)::int as last_at from sites group by 1",
    "motif_iupac": f"""with {_S}, i as (select doc_id, seq, unnest(range(1, length(seq) - 1)) as i from s where length(seq) >= 3)
select s.doc_id, coalesce(n, 0)::int as n_sites from s left join (select doc_id, count(*) as n from i where substr(seq, i, 3) in ('CAG', 'CCG', 'CTG') group by 1) c using (doc_id)""",
    "revcomp": f"with {_S} select doc_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) as revcomp_md5 from s",
    "proximity_tag": f"""with {_S}, n as (select doc_id, spot, spot - lag(spot) over w as a, lead(spot) over w - spot as b from sites window w as (partition by doc_id order by spot))
select doc_id, count(*)::int as n_sites, count(*) filter (coalesce(a, 99) <= 10 or coalesce(b, 99) <= 10)::int as n_near from n group by 1""",
    "gc_content": f"""with {_S}, g as (select doc_id, substr(seq, greatest(spot - 50, 0) + 1, spot + 50 - greatest(spot - 50, 0)) as w from sites)
select doc_id, round(sum((length(w) - length(replace(replace(w, 'G', ''), 'C', ''))) / 100.0::double), 4) as gc_sum from g group by 1""",
    "mm_skips": f"""with {_S}, e as (select doc_id, count(*) as n, max(spot) as last_at, any_value(seq) as seq from sites group by 1)
select doc_id, n::int as n_sites, (length(substr(seq, 1, last_at + 1)) - length(replace(substr(seq, 1, last_at + 1), 'C', '')) - n)::bigint as n_skipped, true as is_same from e""",
    "ml_quantise": "select least(255, floor(prob_1 * 256))::int as ml, count(*) as n_calls from calls where prob_1 between 0 and 1 and not isnan(prob_1) group by 1",
    "contig_cpg": """with p as (select contig, string_split(upper(seq), 'CG') as p from contigs), l as (select contig, generate_subscripts(p, 1) as i, length(unnest(p)) as k, len(p) as n from p)
select contig, (sum(k + 2) over (partition by contig order by i) - 2)::bigint as pos from l qualify i < n""",
    "kmer_codes": """with k as (select row_id, k_mer, generate_series as i from features, generate_series(1, 21) where regexp_full_match(k_mer, '[A-Z]{21}'))
select row_id, sum(i * (strpos('ACGTNWSMKRYBVDHZ', substr(k_mer, i, 1)) - 1))::bigint as code_mix, any_value(substr(k_mer, 9, 5)) as kmer5 from k group by 1""",
    "signal_zscore": f"with {_G}, m as (select vec_id, avg(v) as m, stddev_pop(v) as s from x group by 1) select vec_id, round(sum(case when s = 0 then v else (v - m) / s end * (i + 1)), 4) as mix from x join m using (vec_id) group by 1",
    "signal_mad": f"""with {_G}, m as (select vec_id, median(v) as m from x group by 1), s as (select vec_id, m, median(abs(v - m)) / 0.6744897501960817 as s from x join m using (vec_id) group by 1, 2)
select vec_id, round(sum(case when s = 0 then v else (v - m) / s end * (i + 1)), 4) as mix from x join s using (vec_id) group by 1""",
    "base_stats": f"with {_G} select vec_id, base::int as base, count(*)::int as n_samples, round(avg(v), 5) as mean, round(stddev_pop(v), 5) as std from g group by 1, 2",
    "signal_rect": f"""with {_G}, k as (select *, row_number() over (partition by vec_id, base order by i) - 1 as j, count(*) over (partition by vec_id, base) as n from g),
p as (select vec_id, base, v, case when n <= 3 then (3 - n) // 2 + j end as place, j, n from k)
select vec_id, base::int as base, place::int as place, round(v, 6) as value from p where n <= 3
union all select k.vec_id, k.base::int, t.t::int, round(k.v, 6) from k join (select unnest([0, 1, 2]) as t) t on k.j = floor(t.t * (k.n - 1) / 2.0)::int where k.n > 3""",
    "signal_picoamps": f"with {_G} select vec_id, round(sum((1400.0::double + vec_id % 7) / 8192 * (v + 10) * (i + 1)), 3) as mix from x group by 1",
    "signal_trim": f"""with {_G}, k as (select *, count(*) over (partition by vec_id) as n from x), t as (select * from k where case when vec_id % 2 = 0 then i >= vec_id % 40 else i < n - vec_id % 40 end)
select e.vec_id, coalesce(c, 0)::int as n_samples, round(coalesce(s, 0), 5) as total from embeddings e left join (select vec_id, count(*) as c, sum(v) as s from t group by 1) t using (vec_id)""",
    "signal_fft": f"""with {_G}, n as (select vec_id, len(embedding) as n from embeddings), k as (select vec_id, n, unnest(range(0, n)) as k from n)
select vec_id, k::int as k, round(sqrt(pow(sum(v * cos(2 * pi() * k * i / n)), 2) + pow(sum(v * sin(2 * pi() * k * i / n)), 2)), 4) as magnitude from k join x using (vec_id) group by 1, 2""",
    "infonce_cosine": f"""with {_G}, m as (select label, i, avg(v) as m from x join embeddings using (vec_id) where label is not null group by 1, 2)
select vec_id, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 5) as cosine from x join embeddings using (vec_id) join m using (label, i) group by 1""",
    "alignment_filters": f"""with {_A} select case kind when 0 then '100M' when 1 then '40M5I55M' when 2 then '40M5D60M' else '10S90M' end as cigar, flag, count(*) as n_reads from a
where flag <> 256 and mapq >= 1 and (flag = 4 or (aligned / 100.0 >= 0.95 and 1 - nm / aligned::double >= 0.9)) group by 1, 2""",
    "pct_identity": f"""with {_A} select case kind when 0 then '100M' when 1 then '40M5I55M' when 2 then '40M5D60M' else '10S90M' end as cigar, round(case kind when 1 then 0.95 when 2 then 100 / 105.0 else 1 end::double, 6) as identity,
  case kind when 3 then 90 else 100 end as n_aligned, case kind when 0 then 100 when 1 then 95 when 2 then 105 else 90 end as n_reference, count(*) as n_reads from a group by all""",
    "cigar_lift": f"""with {_A}, k as (select o_orderkey, kind, flag = 16 as rev, aligned, unnest(range(0, aligned)) as i from a where flag in (0, 16)),
p as (select o_orderkey, kind, aligned, i, case kind when 1 then case when i < (case when rev then 55 else 40 end) then i when i < (case when rev then 60 else 45 end) then -1 else i - 5 end
  when 2 then case when i < (case when rev then 60 else 40 end) then i else i + 5 end else i end as r from k)
select o_orderkey, (max(aligned) + 1)::int as n_places, (sum(r * (i + 1)) + (max(aligned) + 1) * max(case kind when 0 then 100 when 1 then 95 when 2 then 105 else 90 end))::bigint as place_mix,
  max(case kind when 0 then 100 when 1 then 95 when 2 then 105 else 90 end)::int as n_back from p group by 1""",
    "signal_alignment_join": f"""with {_A} select read_id, count(*) as n_alignments, max(mapq)::int as best_mapq, max(len(embedding))::int as n_samples from embeddings e join a on a.read_id = 'r' || e.vec_id where flag <> 256 group by 1""",
    "signal_alignment_join_whole": f"""with {_A} select 'r' || o_orderkey as read_id, count(*) as n_alignments, max(mapq)::int as best_mapq, max(len(embedding))::int as n_samples from embeddings e join a on a.o_orderkey = e.vec_id where flag <> 256 group by 1""",
    "kmer_counts": f"with {_R} select kmer, count(*) as n_rows, round(count(*) / (select count(*) from r)::double, 6) as share from r group by 1",
    "kmer_quota": f"""with {_R}, q as (select kmer, ceil(count(*) * 200 / (select count(*) from r where label = 1)::double)::bigint as quota from r where label = 1 group by 1),
m as (select kmer, least(count(*), any_value(quota)) as n_rows from r join q using (kmer) where label = 0 group by 1),
o as (select least(greatest(200 - (select sum(n_rows) from m), 0), (select count(*) from r where label = 0 and kmer not in (select kmer from q)))::bigint as n_rows)
select kmer, n_rows from m union all select null, n_rows from o where n_rows > 0""",
    "kmer_quota_whole": f"""with {_R}, q as (select kmer, count(*) as quota from r where label = 1 group by 1),
m as (select kmer, least(count(*), any_value(quota)) as n_rows from r join q using (kmer) where label = 0 group by 1),
o as (select least(greatest((select count(*) from r where label = 1) - coalesce((select sum(n_rows) from m), 0), 0), (select count(*) from r where label = 0 and kmer not in (select kmer from q)))::bigint as n_rows)
select kmer, n_rows from m union all select null, n_rows from o where n_rows > 0""",
    "kmer_sets": f"""with {_R}, c as (select kmer, count(*) filter (label = 1) as n_pos, count(*) filter (label = 0) as n_neg from r group by 1)
select kmer, n_pos, n_neg, case when n_neg = 0 then 'pos' when n_pos = 0 then 'neg' else 'both' end as found_in from c""",
    "split_halves": f"with {_R}, n as (select count(*) as n from r) select 0 as half, n // 2 as n_rows from n union all select 1, n - n // 2 from n",
    "label_clean": f"""with {_R}, m as (select row_id, label, avg(((row_id * 7919 + k * 104729) % 1000001) / 1e6::double) as p from r, (select unnest([1, 2, 3]) as k) group by 1, 2)
select label, count(*) as n_rows, count(*) filter (case when label = 1 then p >= 0.5 else p < 0.5 end) as n_kept, round(count(*) filter (case when label = 1 then p >= 0.5 else p < 0.5 end) / count(*)::double, 6) as ratio from m group by 1""",
    "score_means": f"""with {_R}, m as (select row_id, ((row_id * 7919 + k * 104729) % 1000001) / 1e6::double as p from r, (select unnest([1, 2, 3]) as k))
select row_id, round(avg(p), 6) as mean_prob, round(stddev_pop(p), 6) as std_prob, count(*) as n_rounds from m group by 1""",
    "metrics_classification": f"""with {_R}, p as (select label, ((row_id * 7919) % 1000001 >= 500000)::int as predicted from r),
c as (select count(*) filter (label = 1 and predicted = 1) as tp, count(*) filter (label = 0 and predicted = 1) as fp, count(*) filter (label = 1 and predicted = 0) as fn, count(*) filter (label = 0 and predicted = 0) as tn from p),
m as (select *, tp / (tp + fp)::double as pr, tp / (tp + fn)::double as rc from c)
select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::double, 6) as accuracy, round(pr, 6) as precision, round(rc, 6) as recall, round(2 * pr * rc / (pr + rc), 6) as f1, round((pr + rc + 2 * pr * rc / (pr + rc)) / 3, 6) as mean_prf from m""",
    "metrics_regression": """with c as (select round(prob_0, 3) as y, prob_1 as p from calls where prob_1 between 0 and 1 and not isnan(prob_1) and prob_0 between 0 and 1 and not isnan(prob_0)),
r as (select y, p, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0::double as ry, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::double as rp from c)
select round(avg((p - y) * (p - y)), 5) as mse, round(avg(abs(p - y)), 5) as mae, round(corr(y, p), 5) as pearson, round(corr(ry, rp), 5) as spearman from r""",
    "bce": """with c as (select called_label as l, prob_1 as q, greatest(least(prob_1, 1 - 1e-7::double), 1e-7::double) as p from calls where prob_1 between 0 and 1 and not isnan(prob_1) and called_label in (0, 1))
select round(avg(-(l * ln(p) + (1 - l) * ln(1 - p))), 5) as bce, round(avg(((q >= 0.5)::int = l)::int), 6) as accuracy from c""",
}
