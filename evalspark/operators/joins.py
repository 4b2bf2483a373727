"""Equality lookups, with keys that hold too many rows for one task spread on request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.columns import add


def hot_keys(rows: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    """Hash of each key with more than ``rows_per_task`` rows, and tasks to spread it over.

    Reads the key column only and counts before shuffling.  At most one key in
    ``rows_per_task`` rows can be listed.
    """
    counted = rows.groupBy(F.xxhash64(key).alias("key_hash")).count()
    return counted.where(f"count > {rows_per_task}").selectExpr(
        "key_hash", f"int(ceil(count / {rows_per_task})) AS tasks"
    )


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str = "question",
    how: str = "left",
    rows_per_task: int | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to a ``table`` that has one row per ``key``.

    A plain join: Spark broadcasts a small table, and splits skewed partitions of a large
    one while it runs.  With ``rows_per_task``, rows of a hot key are also spread over tasks
    by ``row_id`` and the table row is repeated for each; the result is the same.  ``keys``
    is a frame with the same keys that is cheaper to count than computed ``rows``.
    """
    if rows_per_task is None:
        return rows.join(table, key, how)
    hot = hot_keys(rows if keys is None else keys, key, rows_per_task)

    def spread(side: DataFrame, part: str) -> DataFrame:
        hashed = side.withColumn("key_hash", F.xxhash64(key))
        return add(hashed.join(hot, "key_hash", "left"), {"part": part}).drop(
            "key_hash", "tasks"
        )

    left = spread(rows, "int(pmod(xxhash64(row_id), coalesce(tasks, 1)))")
    right = spread(table, "explode(sequence(0, coalesce(tasks, 1) - 1))")
    return left.join(right, [key, "part"], how).drop("part")
