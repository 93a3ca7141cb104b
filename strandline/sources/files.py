"""Paths of inputs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths, each of which must exist in its file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(conf).exists(place):
            raise ValueError(f"no such file or folder: {path}")
    return paths
