"""Session helpers: reading tables, cutting lineage, and joins whose broadcast is size-checked."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: A side of a join is broadcast only if it has at most this many rows and this many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of the data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in tests on one
    machine, a temporary folder is taken; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed once and written to the shared checkpoint folder."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(frame: DataFrame, tasks: int = 1) -> DataFrame:
    """The frame in so many ``tasks`` a core, if it is scanned in fewer: for work that is heavy per row.

    With a single task a core, cores can stand idle while the last tasks run: nine equal tasks on six cores take as long as twelve.
    """
    least = tasks * frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(least) if frame.rdd.getNumPartitions() < least else frame


def is_small(frame: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a frame may be broadcast: its rows and the bytes of its values are counted, no further than just beyond the limit.

    Text and nested columns are measured, others count as 8 bytes. The frame should be cheap to compute again or cut.
    """
    parts = []
    for field in frame.schema.fields:
        if isinstance(field.dataType, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            parts.append(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))))
        else:
            parts.append(F.lit(8))
    width = sum(parts, F.lit(16)).cast("bigint")
    n, total = frame.select(width.alias("w")).limit(rows + 1).agg(F.count("w"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return n <= rows and total <= size


def maybe_broadcast(frame: DataFrame) -> DataFrame:
    """The frame with a broadcast hint if it is small; else as it is, for a join by shuffle."""
    return F.broadcast(frame) if is_small(frame) else frame


def bounded_rows(frame: DataFrame, what: str, rows: int = BROADCAST_ROWS) -> list:
    """The rows of a table that is a parameter, on the driver; an error if it is too large to be one."""
    kept = frame.limit(rows + 1)
    if not is_small(kept, rows):
        raise ValueError(f"{what} is a parameter of at most {rows} rows and {BROADCAST_BYTES} bytes")
    return kept.collect()
