"""Alignments as SAM text, which splits at lines: reading, and writing reads with their modification tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.text import lines


def _tag(name: str, kind: str) -> Column:
    """The value of an optional field; null if it is not there."""
    found = F.regexp_extract("value", rf"\t{name}:{kind}:([^\t]*)", 1)
    return F.when(found != "", found)


def _numbers(name: str) -> Column:
    """The numbers of an array field; null if it is not there."""
    found = F.regexp_extract("value", rf"\t{name}:B:[cCsSiI],([^\t]*)", 1)
    return F.when(found != "", F.transform(F.split(found, ","), lambda x: x.try_cast("int")))


def read_sam(spark: SparkSession, paths: list[str], name_part: str = "") -> DataFrame:
    """Alignments of SAM files: ``read_id, parent_id, flag, mapq, ref_name, ref_start, cigar, seq, stride, moves, ts, sp, nm, mm, ml``.

    Header lines and lines with fewer than eleven columns are left out. ``read_id`` is the parent's where a ``pi`` tag names one;
    ``*`` and an unset place are null; places count from 0. Secondary and supplementary alignments stay, with their flags.
    """
    cut = F.split("value", "\t")
    rows = lines(spark, paths, name_part).where(~F.col("value").startswith("@") & (F.size(F.split("value", "\t")) >= 11))
    column = lambda i: F.when(cut[i] != "*", cut[i])
    moves = _numbers("mv")
    place = cut[3].try_cast("bigint") - 1
    whole = lambda name: _tag(name, "i").try_cast("int").alias(name)
    return rows.select(
        F.coalesce(_tag("pi", "Z"), cut[0]).alias("read_id"), _tag("pi", "Z").alias("parent_id"), cut[1].try_cast("int").alias("flag"), cut[4].try_cast("int").alias("mapq"), column(2).alias("ref_name"), F.when(place >= 0, place).alias("ref_start"),
        column(5).alias("cigar"), column(9).alias("seq"), F.get(moves, 0).alias("stride"), F.slice(moves, 2, F.greatest(F.size(moves) - 1, F.lit(0))).alias("moves"), whole("ts"), whole("sp"),
        _tag("NM", "i").try_cast("int").alias("nm"), _tag("MM", "Z").alias("mm"), _numbers("ML").alias("ml"),
    )


def sam_lines(reads: DataFrame, ordered: bool = True) -> DataFrame:
    """``line, ref_name, ref_start``: one line per alignment, sorted by contig and place if ``ordered`` (ranges of lines, sorted inside), unmapped reads last.

    Needs the columns of :func:`read_sam` from ``read_id`` to ``nm``, with ``mm`` and ``ml`` or without.
    """
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    unmapped = F.col("flag").bitwiseAND(4) != 0
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    tags = [
        F.when(F.size("moves") > 0, F.concat(F.lit("mv:B:c,"), F.col("stride").cast("string"), F.lit(","), joined("moves"))), F.concat(F.lit("ts:i:"), F.col("ts").cast("string")), F.concat(F.lit("sp:i:"), F.col("sp").cast("string")),
        F.concat(F.lit("NM:i:"), F.col("nm").cast("string")),
    ]
    if "mm" in reads.columns:
        tags += [F.concat(F.lit("MM:Z:"), F.col("mm")), F.when(F.size("ml") > 0, F.concat(F.lit("ML:B:C,"), joined("ml")))]
    fixed = [
        F.col("read_id"), F.col("flag").cast("string"), F.when(unmapped, "*").otherwise(star("ref_name")), F.when(unmapped, F.lit("0")).otherwise(F.coalesce((F.col("ref_start") + 1).cast("string"), F.lit("0"))), F.coalesce(F.col("mapq").cast("string"), F.lit("0")),
        F.when(unmapped, "*").otherwise(star("cigar")), F.lit("*"), F.lit("0"), F.lit("0"), star("seq"), F.lit("*"),
    ]
    out = reads.select(F.concat_ws("\t", *fixed, *tags).alias("line"), F.when(~unmapped, F.col("ref_name")).alias("ref_name"), F.when(~unmapped, F.col("ref_start")).alias("ref_start"))
    return out.orderBy(F.asc_nulls_last("ref_name"), "ref_start", "line") if ordered else out
