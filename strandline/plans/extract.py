"""From signals and alignments to feature rows: one relational pipeline.

Signals meet the alignments of their read in one join. Trimming, scaling, move tables, motif sites, lifting and windows are column
expressions over the read's arrays; only the finished windows of the kept sites are exploded, so no site carries its whole read along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import cigar, modtags, seq, signal
from strandline.functions.arrays import chunks
from strandline.functions.kernels import near_letter
from strandline.operators import filters
from strandline.operators.skew import split_join


@dataclass(frozen=True)
class Settings:
    """What is extracted: motifs and the modified letter's place in them, window sizes, filters, scaling and label."""

    motifs: str = "CG"
    mod_loc: int = 0
    kmer: int = 21
    samples: int = 15
    mapq: int = 1
    fraction: float = 0.5
    identity: float = 0.0
    scaling: str = "mad"
    label: int = 1
    #: The proximity tag looks for any other C, not only for other sites.
    any_c: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


def _clip(cigar_text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(cigar_text, pattern, 1).try_cast("int"), F.lit(0))


def prepared_reads(signals: DataFrame, alignments: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Reads with their alignment and ``status``: ``ok``, or the first filter that holds them back.

    ``signals(read_id, signal)``; ``alignments(read_id, flag, mapq, ref_name, ref_start, cigar, seq, stride, moves, ts, sp, nm)`` with the
    sequence as aligned. Each alignment of a read is one row; signals without alignment and the reverse are left out. Adds ``forward`` (the
    sequence as sequenced), ``scaled`` (the trimmed, scaled signal) and the aligned interval in the direction of sequencing.
    """
    rows = signals.select("read_id", "signal").join(alignments, "read_id")
    mapped, reverse = ~filters.is_unmapped(F.col("flag")), filters.is_reverse(F.col("flag"))
    lead, trail = _clip(F.col("cigar"), r"^(?:\d+H)?(\d+)S"), _clip(F.col("cigar"), r"(\d+)S(?:\d+H)?$")
    n_aligned = cigar.aligned_length(F.col("cigar"))
    trimmed = signal.trimmed(F.col("signal"), F.col("ts") + F.coalesce("sp", F.lit(0)), F.lit(None).cast("int"))
    scaled = signal.mad_scaled(trimmed) if settings.scaling == "mad" else signal.standardised(trimmed)
    out = rows.withColumns({
        "is_mapped": mapped, "is_reverse": reverse, "n_aligned": F.when(mapped, n_aligned), "ref_length": F.when(mapped, cigar.reference_length(F.col("cigar"))),
        "forward": F.when(reverse, seq.reverse_complement(F.col("seq"))).otherwise(F.upper("seq")), "seq_start": F.when(mapped, F.when(reverse, trail).otherwise(lead)), "scaled": scaled,
    })
    chrom = F.when(mapped, F.col("ref_name")).otherwise(".")
    chosen = ((F.lit(not settings.include) | chrom.isin(list(settings.include))) & ~chrom.isin(list(settings.exclude))) if settings.include or settings.exclude else F.lit(True)
    short = F.size("scaled") < F.size("moves") * F.col("stride")
    status = (
        F.when(~filters.is_primary(F.col("flag")), "secondary").when(F.col("mapq") < settings.mapq, "low_mapq").when(F.col("seq").isNull() | F.col("moves").isNull() | (F.size("moves") == 0), "no_moves")
        .when(F.col("signal").isNull() | ~F.coalesce(F.try_element_at("moves", F.lit(1)) == 1, F.lit(False)) | short, "bad_moves").when(~chosen, "other_contig")
        .when(mapped & (F.col("n_aligned") / F.length("seq") < settings.fraction), "low_coverage").when(mapped & (1 - F.try_divide("nm", "n_aligned") < settings.identity), "low_identity").otherwise("ok")
    )
    return out.withColumn("chrom", chrom).withColumn("status", status)


def _sites(settings: Settings) -> Column:
    """``loc, tag, rpos`` of the sites of a read that pass the edge, the aligned interval and the insertion filter."""
    half, n = settings.kmer // 2, F.length("forward")
    both = F.zip_with("places", "tags", lambda loc, tag: F.struct(loc.alias("loc"), tag.alias("tag"), F.when(F.col("is_mapped"), F.get("lift", loc - F.col("seq_start"))).alias("rpos")))
    inside = lambda s: F.coalesce((s["loc"] >= F.col("seq_start")) & (s["loc"] < F.col("seq_start") + F.col("n_aligned")) & (s["rpos"] >= 0), F.lit(False))
    return F.filter(both, lambda s: (s["loc"] >= half) & (s["loc"] < n - half) & (s["loc"] < F.size("bounds") - half) & (~F.col("is_mapped") | inside(s)))


def _window(site: Column, settings: Settings) -> Column:
    """The window of one site: k-mer and the samples of its bases. Letters are taken from pieces, not from the front of the read."""
    first = site["loc"] - settings.kmer // 2
    piece = F.floor(first / F.lit(seq.PIECE)).cast("int")
    kmer = F.substring(F.get("pieces", piece), first - piece * seq.PIECE + 1, F.lit(settings.kmer))
    groups = F.transform(F.slice("bounds", first + 1, F.lit(settings.kmer)), lambda b: F.slice("scaled", b["begin"] + 1, b["size"]))
    return F.struct(site["loc"].alias("loc"), site["tag"].alias("tag"), site["rpos"].alias("rpos"), kmer.alias("k_mer"), groups.alias("groups"))


def site_windows(reads: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per kept site of the reads with status ``ok``: its place on the reference, tag, k-mer and the samples of each base of its window."""
    lift = F.when(F.col("is_mapped"), cigar.query_to_reference(F.col("cigar"), F.col("is_reverse")))
    ready = reads.where("status = 'ok'").withColumns({"bounds": signal.bounds(F.col("moves"), F.col("stride"), F.size("scaled")), "lift": lift, "pieces": chunks(F.col("forward"), seq.PIECE, settings.kmer)})
    found = ready.withColumn("places", seq.motif_sites(F.col("forward"), seq.expand(settings.motifs), settings.mod_loc))
    tags = near_letter("C", seq.PROXIMITY)(F.col("forward"), F.col("places")) if settings.any_c else seq.proximity(F.col("places"))
    sites = found.withColumn("tags", tags).withColumn("sites", _sites(settings))
    ref_end = F.col("ref_start") + F.col("ref_length")
    rows = sites.select("read_id", "chrom", "is_mapped", "is_reverse", "ref_start", ref_end.alias("ref_end"), F.explode(F.transform("sites", lambda s: _window(s, settings))).alias("w"))
    pos = F.when(~F.col("is_mapped"), F.lit(-1)).when(F.col("is_reverse"), F.col("ref_end") - 1 - F.col("w.rpos")).otherwise(F.col("ref_start") + F.col("w.rpos"))
    strand = F.when(~F.col("is_mapped"), ".").when(F.col("is_reverse"), "-").otherwise("+")
    return rows.select("chrom", pos.cast("bigint").alias("pos"), strand.alias("strand"), "read_id", F.col("w.loc").alias("loc"), F.col("w.tag").alias("tag"), F.col("w.k_mer").alias("k_mer"), F.col("w.groups").alias("groups"))


def features(signals: DataFrame, alignments: DataFrame, settings: Settings = Settings(), positions: DataFrame | None = None, reference: DataFrame | None = None, padding: float = 0.0) -> DataFrame:
    """Feature rows of all sites: the columns of the features table.

    ``positions`` keeps listed sites only, strand included. ``reference(contig, length)`` rejects mapped reads of other contigs and gives the place
    in the strand, else ``.``. Places without a sample hold ``padding`` (NaN for models that mask them).
    """
    windows = site_windows(prepared_reads(signals, alignments, settings), settings)
    if positions is not None:
        windows = filters.at_positions(windows, positions)
    in_strand = F.lit(".")
    if reference is not None:
        lengths = reference.select(F.col("contig").alias("chrom"), F.col("length").alias("_length"))
        windows = split_join(windows, lengths, "chrom", "left").where("_length is not null or chrom = '.'")
        in_strand = F.when(F.col("strand") == "-", F.col("_length") - 1 - F.col("pos")).otherwise(F.col("pos")).cast("string")
    stat = lambda f: F.transform("groups", f)
    return windows.select(
        "chrom", "pos", "strand", in_strand.alias("pos_in_strand"), F.col("read_id").alias("readname"), F.lit(".").alias("read_loc"), "k_mer", stat(signal.mean).alias("signal_means"), stat(signal.deviation).alias("signal_stds"),
        F.transform("groups", F.size).alias("signal_lens"), signal.rectangle(F.col("groups"), settings.samples, padding).alias("raw_signals"), F.lit(settings.label).alias("methy_label"), "tag", "loc",
    )


def tagged_reads(reads: DataFrame, called: DataFrame) -> DataFrame:
    """Reads with status ``ok`` and their ``mm`` and ``ml`` tags; reads without called sites stay, with null tags.

    ``called(read_id, loc, prob_1)`` are the calls of single sites. The calls of a read meet in one row, as its record must.
    """
    lists = called.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("loc", "prob_1"))).alias("_calls"))
    kept = reads.where("status = 'ok'").join(lists, "read_id", "left")
    places, probs = F.transform("_calls", lambda c: c["loc"]), F.transform("_calls", lambda c: c["prob_1"])
    tagged = kept.withColumn("mm", F.when(F.col("_calls").isNotNull(), modtags.mm_tag(F.col("forward"), F.coalesce(places, F.array().cast("array<int>")))))
    return tagged.withColumn("ml", F.when(F.col("mm").isNotNull(), modtags.ml_tag(probs))).drop("_calls")
