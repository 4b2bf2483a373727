"""Sums of fixed-size arrays over all partitions of a frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(df: DataFrame, size: int, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``of(batch)``, ``size`` numbers, over all batches.

    Each partition sends one row a position; Spark adds them, and only ``size`` sums come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "value": total[at]})

    rows = df.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for row in rows.collect():
        out[row["at"]] = row["value"]
    return out


def held_out(doc_id: str = "doc_id"):
    """Rows kept from all learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
