"""What the two vector searches share: usable vectors, blocks of rows, and queries dealt to blocks.

A vector takes part if it is not null and holds only finite numbers.  Rows are dealt into blocks of
bounded size; each block is one sorted run of a task's input, first its rows and then the
queries sent to it, so a task holds one block and one batch of queries at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HITS = "query_id long, vec_id long, score double, score_long long"


def usable(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part: of those, the commonest length only."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("vec_id is not null and vector is not null").where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), "length").first()
    return rows.where(F.size("vector") == (first["length"] if first else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def search(rows: DataFrame, queries: DataFrame, prepare: Callable, answer: Callable, parts: int) -> DataFrame:
    """Hits of ``answer(prepare(ids, vectors), query ids, queries, bounds)`` for every block.

    ``rows`` has block, vec_id, vector; ``queries`` also bound, a value from earlier searches.
    """
    both = rows.select("block", F.lit(0).alias("is_query"), "vec_id", F.lit(None).cast("double").alias("bound"), "vector").unionByName(
        queries.select("block", F.lit(1).alias("is_query"), "vec_id", "bound", "vector")
    )
    dealt = both.repartition(parts, "block").sortWithinPartitions("block", "is_query", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                ids, vectors = np.asarray(part.column(2)), matrix(part.column(4))
                if blocks[a] != now:
                    now, held, ready = blocks[a], [], None
                if not kinds[a]:
                    held.append((ids, vectors))
                    continue
                if held:
                    ready = prepare(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                if ready is not None:
                    bounds = np.asarray(part.column(3).fill_null(np.inf), float)
                    for c in range(0, len(ids), 256):
                        yield answer(ready, ids[c : c + 256], vectors[c : c + 256], bounds[c : c + 256])

    return dealt.mapInArrow(run, HITS)


def hits(query_id: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    whole = score.dtype.kind == "i"
    none = np.zeros(len(score))
    return pa.RecordBatch.from_pydict({
        "query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(vec_id, pa.int64()),
        "score": pa.array(none if whole else score, pa.float64()), "score_long": pa.array(score if whole else none.astype(np.int64), pa.int64()),
    })


def ranked(found: DataFrame, order: list, k: int) -> DataFrame:
    """The first k hits of each query, with rank from 1; Spark keeps k a task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def route(queries: DataFrame, blocks: Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]) -> DataFrame:
    """A row for each query and block to search; ``blocks(vectors, bounds)`` names the blocks of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                found = blocks(matrix(part.column(1)), np.asarray(part.column(2).fill_null(np.inf), float))
                for row, own in enumerate(found):
                    for a in range(0, len(own), 4096):
                        some = pa.array(own[a : a + 4096], pa.int64())
                        again = pa.array(np.full(len(some), row))
                        yield pa.RecordBatch.from_arrays([some, *(c.take(again) for c in part.columns)], ["block", "vec_id", "vector", "bound"])

    return queries.select("vec_id", "vector", "bound").mapInArrow(run, "block long, vec_id long, vector array<double>, bound double")
