"""Spark-native analytics over nanopore methylation calls, features and their texts."""

__version__ = "0.1.0"
