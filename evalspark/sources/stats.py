"""Statistics as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_stats(stats: DataFrame, path: str) -> None:
    """Write a small statistics frame as JSON lines, nulls kept."""
    stats.coalesce(1).write.option("ignoreNullFields", False).json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
