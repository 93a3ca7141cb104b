"""Running site frequencies over a stream of call files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.schemas import CALLS


def call_stream(spark: SparkSession, directory: str, files_per_batch: int = 16) -> DataFrame:
    """Calls of tab-separated files as they arrive in a directory."""
    return spark.readStream.schema(CALLS).option("sep", "\t").option("quote", "").option("nullValue", ".").option("maxFilesPerTrigger", files_per_batch).csv(directory)


def running_sites(calls: DataFrame, least: float = 0.5) -> DataFrame:
    """Coverage, modified calls and frequency of each site so far, for output mode ``update`` or ``complete``."""
    used = calls.where(F.abs(F.col("prob_0") - F.col("prob_1")) >= least)
    sums = used.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("coverage"), F.count_if(F.col("called_label") == 1).alias("count_modified"))
    return sums.withColumn("modification_frequency", F.col("count_modified") / F.col("coverage"))


def windowed_usage(calls: DataFrame, time: str = "called_at", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls and modified calls per contig and window of time; rows later than the watermark are dropped by design of the stream."""
    return calls.withWatermark(time, late).groupBy(F.window(time, width), "chrom").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("called_label") == 1).alias("n_modified"))
