"""Delimited text files of the domain: call, feature and position tables, FASTA and SLOW5; and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.schemas import CALLS
from strandline.sources.files import existing
from strandline.sources.records import numbered_lines, records


def lines(spark: SparkSession, paths: list[str], name_part: str = "") -> DataFrame:
    """``file_name, value`` of the lines of text files, compressed or not; of a folder those whose name contains ``name_part``."""
    reader = spark.read.option("pathGlobFilter", f"*{name_part}*") if name_part else spark.read
    return reader.text(existing(spark, paths)).select(F.col("_metadata.file_path").alias("file_name"), "value")


def read_calls(spark: SparkSession, paths: list[str], name_part: str = "") -> DataFrame:
    """Call rows with ``row_id`` that follows file and line, and ``reject``: null, ``column_count`` or ``bad_value``.

    ``.`` stands for a missing place in the strand. A rejected row keeps its line in ``raw`` and has null values.
    """
    text = numbered_lines(spark, paths, name_part).withColumnRenamed("line_no", "row_id")
    cut = F.split(F.regexp_replace("value", r"\s+$", ""), "\t")
    names = [part.split() for part in CALLS.split(", ")]
    optional = {"pos_in_strand"}
    typed = {n: (F.try_element_at(cut, F.lit(i + 1)) if t == "string" else F.try_element_at(cut, F.lit(i + 1)).try_cast(t)) for i, (n, t) in enumerate(names)}
    missing = F.lit(False)
    for n, c in typed.items():
        missing = missing | (c.isNull() if n not in optional else F.lit(False))
    reject = F.when(F.size(cut) < 10, "column_count").when(missing, "bad_value")
    out = text.select("row_id", "file_name", F.col("value").alias("raw"), reject.alias("reject"), *[c.alias(n) for n, c in typed.items()])
    return out.select("row_id", "file_name", "reject", F.when(F.col("reject").isNotNull(), F.col("raw")).alias("raw"), *[F.when(F.col("reject").isNull(), F.col(n)).alias(n) for n, _ in names])


def read_feature_lines(spark: SparkSession, paths: list[str], name_part: str = "") -> DataFrame:
    """``line_no, file_name, line_text`` for the parser of feature lines, records assembled over line breaks inside enclosed fields."""
    return records(spark, paths, name_part)


def read_positions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct ``chrom, pos, strand`` of the first three columns."""
    cut = F.split(lines(spark, paths)["value"], r"\s+")
    return lines(spark, paths).select(cut[0].alias("chrom"), F.try_element_at(cut, F.lit(2)).try_cast("bigint").alias("pos"), F.try_element_at(cut, F.lit(3)).alias("strand")).dropna().distinct()


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``contig, seq, length``: records are split at ``>``; the contig is the first word, letters come out upper case."""
    records = spark.read.option("lineSep", ">").text(existing(spark, paths)).where(F.length(F.trim("value")) > 0)
    head, body = F.regexp_extract("value", r"^(\S+)", 1), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "")
    return records.select(head.alias("contig"), F.upper(body).alias("seq")).withColumn("length", F.length("seq"))


def read_slow5(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``read_id, digitisation, offset, range, sampling_rate, signal`` of SLOW5 text files; header lines are left out."""
    cut = F.split("value", "\t")
    number = lambda i: F.try_element_at(cut, F.lit(i)).try_cast("double")
    rows = lines(spark, paths).where(~F.col("value").rlike("^[#@]") & (F.size(cut) >= 8))
    return rows.select(cut[0].alias("read_id"), number(3).alias("digitisation"), number(4).alias("offset"), number(5).alias("range"), number(6).alias("sampling_rate"), F.transform(F.split(cut[7], ","), lambda x: x.try_cast("double")).alias("signal"))


def decimals(value: Column, places: int) -> Column:
    """A number with fixed decimals, as text."""
    return F.format_string(f"%.{places}f", value)


def site_lines(sites: DataFrame) -> DataFrame:
    """Site frequencies as tab-separated lines: sums with three decimals, the frequency with four, ``.`` for null."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    parts = [dot("chrom"), dot("pos"), dot("strand"), dot("pos_in_strand"), decimals(F.col("prob_0_sum"), 3), decimals(F.col("prob_1_sum"), 3), dot("count_modified"), dot("count_unmodified"), dot("coverage"), decimals(F.col("modification_frequency"), 4), dot("k_mer")]
    return sites.select(F.concat_ws("\t", *parts).alias("value"))


def call_line() -> Column:
    """A call as a tab-separated line: probabilities with six decimals, ``.`` for null."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return F.concat_ws("\t", dot("chrom"), dot("pos"), dot("strand"), dot("pos_in_strand"), dot("readname"), dot("read_loc"), decimals(F.col("prob_0"), 6), decimals(F.col("prob_1"), 6), dot("called_label"), dot("k_mer"))


def call_lines(calls: DataFrame) -> DataFrame:
    """Calls as lines."""
    return calls.select(call_line().alias("value"))


def feature_lines(features: DataFrame) -> DataFrame:
    """Feature rows as tab-separated lines: six decimals, arrays joined by ``,``, rows of samples by ``;``, NaN as 0."""
    one = lambda x: decimals(F.nanvl(x, F.lit(0.0)), 6)
    flat = lambda c: F.array_join(F.transform(c, one), ",")
    raw = F.array_join(F.transform("raw_signals", lambda r: F.array_join(F.transform(r, one), ",")), ";")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    parts = [dot("chrom"), dot("pos"), dot("strand"), dot("pos_in_strand"), dot("readname"), dot("read_loc"), dot("k_mer"), flat("signal_means"), flat("signal_stds"), F.array_join(F.transform("signal_lens", lambda x: x.cast("string")), ","), raw, dot("methy_label"), dot("tag")]
    return features.select(F.concat_ws("\t", *parts).alias("value"))


def write_lines(frame: DataFrame, path: str, rows_per_file: int = 0, gzip: bool = False) -> None:
    """Write one column of lines; ``rows_per_file`` rolls files over."""
    writer = frame.write.mode("overwrite").option("compression", "gzip" if gzip else "none")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).text(path)
