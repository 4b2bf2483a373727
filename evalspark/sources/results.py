"""Question and result tables on disk."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.booleans import tri_state
from evalspark.sources.records import numbered_parquet, read_csv
from evalspark.sources.schema import FLAG_COLUMNS, RESULT_COLUMNS, RESULT_SCHEMA

KEYED_SCHEMA = T.StructType([T.StructField("row_id", T.LongType())] + RESULT_SCHEMA.fields)


def select_questions(source: DataFrame, answer: str = "best_answer") -> DataFrame:
    """Project a question set to ``question`` and ``ground_truth``, keeping ``row_id``."""
    return source.select("row_id", "question", F.col(answer).alias("ground_truth"))


def read_questions(spark: SparkSession, path: str, answer: str = "best_answer") -> DataFrame:
    """A question set from Parquet or quoted CSV (``*.csv``); ``row_id`` is the position in the file.

    Positions are the same however many tasks read the files.
    """
    if path.rstrip("/").endswith(".csv"):
        return select_questions(read_csv(spark, path, spark.read.option("header", True).csv(path).columns), answer)
    return select_questions(numbered_parquet(spark, path), answer)


def head_rows(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows by ``row_id``, for a trial run."""
    return rows.orderBy("row_id").limit(n)


def _mismatch(spark: SparkSession, found: object, expected: object, on_mismatch: str) -> DataFrame:
    if on_mismatch != "empty":
        raise ValueError(f"the table has {found}, not {expected}")
    return spark.createDataFrame([], KEYED_SCHEMA)


def read_results_csv(
    spark: SparkSession,
    path: str,
    header: Sequence[str] | None = None,
    on_mismatch: str = "error",
) -> DataFrame:
    """Read an exported result table: quoted text with line breaks, booleans as words.

    Without a column ``row_id`` the rows are numbered by their position, file after file.
    The files must hold exactly the expected columns in order; a table written under other
    names is read by passing its ``header``.  A table with another header is refused, or
    with ``on_mismatch="empty"`` gives an empty table, so that a run starts afresh rather
    than mixing two schemas; where the first file is right and another is not, that one is
    refused by name.  Files are read by many tasks, also within quoted text.
    """
    found = spark.read.option("header", True).csv(path).columns
    expected = list(header or RESULT_COLUMNS)
    keyed = ["row_id", *expected] if header is None else expected
    if found not in (expected, keyed):
        return _mismatch(spark, found, expected, on_mismatch)
    raw = read_csv(spark, path, [f"c{i}" for i in range(len(found))], names=found)
    if len(found) > len(RESULT_COLUMNS):
        raw = raw.drop("row_id")
    return raw.toDF("row_id", *RESULT_COLUMNS).selectExpr(
        "bigint(row_id) AS row_id",
        *(
            f"{tri_state(f.name)} AS {f.name}"
            if f.name in FLAG_COLUMNS
            else f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in RESULT_SCHEMA.fields
        ),
    )


def guard_schema(rows: DataFrame, on_mismatch: str = "error") -> DataFrame:
    """The rows if they have the result columns with their types in order; else an error, or
    with ``on_mismatch="empty"`` an empty result table."""
    expected = [(f.name, f.dataType.simpleString()) for f in RESULT_SCHEMA.fields]
    found = [c for c in rows.dtypes if c[0] != "row_id"]
    if found == expected and ("row_id", "bigint") in rows.dtypes:
        return rows
    return _mismatch(rows.sparkSession, rows.dtypes, expected, on_mismatch)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """file and schema (names and types) of every Parquet file, read from its footer by the executors.

    Files are listed by Spark and opened through Arrow, so the store must be one that Arrow knows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for batch in batches:
            paths = batch.column(0).to_pylist()
            found = []
            for uri in paths:
                store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
                with store.open_input_file(place) as file:
                    found.append(", ".join(f"{c.name} {c.physical_type} {c.logical_type.type}" for c in _leaves(pq.read_metadata(file).schema)))
            yield pa.RecordBatch.from_pydict({"file": paths, "schema": found})

    return files.mapInArrow(run, "file string, schema string")


def _leaves(schema) -> list:
    return [schema.column(i) for i in range(len(schema))]


def guard_files(spark: SparkSession, path: str) -> None:
    """Refuses a folder whose Parquet files do not all have one schema, and names files of the rarer ones.

    Where Arrow does not know the store, Spark's own merging of all footers is asked instead; it
    finds other types and columns, but names no file.
    """
    if re.match("(file|hdfs|s3|gs|gcs):|/", path):
        by = footers(spark, path).groupBy("schema").agg(F.count("*").alias("n"), F.min("file").alias("file"))
        kinds = by.orderBy(F.desc("n"), "file").limit(4).collect()
        if len(kinds) > 1:
            others = "; ".join(f"{k['n']} files such as {k['file']}: {k['schema']}" for k in kinds[1:])
            raise ValueError(f"{path} has files of several schemas: {kinds[0]['n']} have {kinds[0]['schema']}, but {others}")
    else:
        one, every = (spark.read.option("mergeSchema", merged).parquet(path).dtypes for merged in (False, True))
        if sorted(one) != sorted(every):
            raise ValueError(f"{path} has files of several schemas: {one} and {every}")


def read_results(spark: SparkSession, path: str, on_mismatch: str = "error") -> DataFrame:
    """Read a result table, and only if all its files have the expected schema."""
    try:
        guard_files(spark, path)
    except ValueError as several:
        return _mismatch(spark, several, RESULT_COLUMNS, on_mismatch)
    return guard_schema(spark.read.parquet(path), on_mismatch)


def write_results(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the result columns in their fixed order, as Parquet."""
    rows.select("row_id", *RESULT_COLUMNS).write.mode(mode).parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """Write any flat table as quoted CSV with a header; white space stays as it is."""
    rows.write.options(
        header=True, quote='"', escape='"', emptyValue="", quoteAll=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
