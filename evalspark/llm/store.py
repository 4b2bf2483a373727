"""Where operators keep tables and files that outlive one job: the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evalspark.sources.folders import fresh_path, shared_folder  # noqa: F401


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage ends here."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_columns(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` and further columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions_for(spark: SparkSession, size: int, share: int) -> int:
    """Partitions for ``size`` (bytes or rows) at ``share`` each, but not fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // share), 1)
