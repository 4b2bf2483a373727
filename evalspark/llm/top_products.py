"""Exact top-k search by inner product.

Vectors are rotated by the singular vectors of all rows, so that the first coordinates hold most
of every product.  Rows are dealt into bands by descending length and processed in that order.
A band, a run of rows or a row is passed over when the Cauchy-Schwarz bound (the partial sum over
the first coordinates plus the product of the remaining lengths) is below the k-th best score
so far; what is left gets its exact integer score.  Nothing is lost: bounds are rounded up.

Components are floor(scale * x).  Null and non-finite vectors take no part, nor do those of another
length than the commonest, nor rows without an id; zero vectors do.  Ties go to the smaller
vec_id.  Rows that repeat an id are candidates of their own; a repeated query is asked once, with its
smallest vector.  Scores beyond a long are held at its ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import store, vectors
from evalspark.llm.sums import summed
from evalspark.llm.vectors import hits, matrix

BLOCK, BANDS, RUN = 1024, 32, 128
SLACK = 1e-9  # of the product of lengths; above the rounding of any sum here
_LEAST, _MOST = -(2**63), 2**63 - 1


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where these hold them, else in Python's numbers."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    if np.linalg.norm(queries, axis=1).max() * np.linalg.norm(rows, axis=1).max() < 2**52:
        return (queries @ rows.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in rows]
    return np.array([[min(max(sum(a * b for a, b in zip(map(int, q), r, strict=True)), _LEAST), _MOST) for r in whole] for q in queries], np.int64)


@dataclass
class Block:
    ids: np.ndarray
    rows: np.ndarray
    head: np.ndarray  # first rotated coordinates
    rest: np.ndarray  # length of the others
    length: np.ndarray


def search(rows: DataFrame, queries: DataFrame, k: int, scale: float, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products with other rows."""
    spark = rows.sparkSession
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    # Doubles from 2**53 on are whole already, and floor() would not fit a long.
    scaled = F.transform("vector", lambda x: x * F.lit(float(scale)))
    floored = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    every = vectors.usable(rows, vector, vec_id).withColumn("vector", floored).withColumn("length", length)
    asked = vectors.usable(queries, vector, vec_id).withColumn("vector", floored)
    asked = store.written(asked.groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    size = every.selectExpr("max(size(vector)) AS n").first()["n"] or 0

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return (x.T @ x).ravel()

    gram = summed(every.select("vector"), size * size, moments).reshape(size, size)
    energy, axes = np.linalg.eigh(gram) if size else (np.zeros(0), np.zeros((0, 0)))
    axes = axes[:, np.argsort(-energy)]
    head = max(size // 4, min(size, 1))

    shares = [i / BANDS for i in range(BANDS - 1, 0, -1)]
    edges = every.agg(F.percentile_approx("length", shares, 10_000)).first()[0] or []
    edges = sorted(set(edges), reverse=True)
    band = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        band = F.when(F.col("length") >= edges[i], i).otherwise(band)
    banded = every.withColumn("band", band)
    n, longest = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1)
    for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect():  # BANDS rows
        n[r["band"]], longest[r["band"]] = r["n"], r["longest"]
    blocks = np.maximum(-(-n // BLOCK), 1)
    first = np.cumsum(blocks) - blocks
    table = F.array(*(F.struct(F.lit(int(a)).alias("first"), F.lit(int(m)).alias("n")) for a, m in zip(first, blocks, strict=True)))
    own = table[F.col("band")]
    blocked = banded.select((own["first"] + F.pmod(F.xxhash64("vec_id", "vector"), own["n"])).cast("long").alias("block"), "vec_id", "vector")
    start = int(np.searchsorted(np.cumsum(n), min(k + 1, n.sum()))) if n.sum() else 0

    def prepare(ids: np.ndarray, rows: np.ndarray) -> Block:
        length = np.linalg.norm(rows, axis=1)
        order = np.lexsort((ids, -length))
        turned = rows[order] @ axes
        return Block(ids[order], rows[order], turned[:, :head], np.linalg.norm(turned[:, head:], axis=1), length[order])

    def answer(block: Block, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        turned, lengths = queries @ axes, np.linalg.norm(queries, axis=1)
        heads, rests = turned[:, :head], np.linalg.norm(turned[:, head:], axis=1)
        known = np.where(np.isfinite(bounds), bounds, -np.inf)
        scores = np.full((len(queries), k), _LEAST, np.int64)
        names = np.zeros((len(queries), k), np.int64)
        filled = np.zeros((len(queries), k), bool)
        for begin in range(0, len(block.ids), RUN):
            part = slice(begin, begin + RUN)
            least = np.maximum(known, np.where(filled[:, -1], scores[:, -1].astype(float), -np.inf))
            slack = SLACK * lengths[:, None] * block.length[part] + SLACK
            bound = heads @ block.head[part].T + rests[:, None] * block.rest[part]
            left = (np.minimum(bound, lengths[:, None] * block.length[part]) + slack >= least[:, None]) & (block.ids[part][None, :] != query_ids[:, None])
            active, columns = np.flatnonzero(left.any(axis=1)), np.flatnonzero(left.any(axis=0))
            if not len(active):
                if (lengths * block.length[begin] + SLACK * (1 + lengths * block.length[begin]) < least).all():
                    break
                continue
            products = exact(queries[active], block.rows[part][columns])
            ids = np.broadcast_to(block.ids[part][columns], products.shape)
            usable = left[np.ix_(active, columns)]
            every = np.concatenate([scores[active], np.where(usable, products, _LEAST)], axis=1)
            named = np.concatenate([names[active], ids], axis=1)
            full = np.concatenate([filled[active], usable], axis=1)
            order = np.lexsort((named, ~every, ~full), axis=1)[:, :k]
            scores[active], names[active], filled[active] = (np.take_along_axis(x, order, 1) for x in (every, named, full))
        at, place = np.nonzero(filled & (scores >= known[:, None]))
        return hits(query_ids[at], names[at, place], scores[at, place])

    def starting(queries: np.ndarray, bounds: np.ndarray):
        for _ in queries:
            yield np.arange(first[start] + 1)

    def remaining(queries: np.ndarray, bounds: np.ndarray):
        reach = np.linalg.norm(queries, axis=1)[:, None] * longest * (1 + SLACK) + SLACK
        left = (reach >= np.where(np.isfinite(bounds), bounds, -np.inf)[:, None]) & (np.arange(len(n)) >= start) & (n > 0)
        for row in left:
            every = np.concatenate([np.zeros(0, np.int64), *(np.arange(first[b], first[b] + blocks[b]) for b in np.flatnonzero(row))])
            yield every[every > first[start]]

    parts = store.partitions_for(spark, int(blocks.sum()), 1)
    order = [F.desc("score_long"), F.asc("vec_id")]
    none = asked.withColumn("bound", F.lit(None).cast("double"))
    near = vectors.search(blocked, vectors.route(none, starting), prepare, answer, parts)
    near = store.written(vectors.ranked(near, order, k), "near")
    bound = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score_long").cast("double").alias("bound"))
    more = vectors.search(blocked, vectors.route(asked.join(bound, "vec_id", "left"), remaining), prepare, answer, parts)
    return vectors.ranked(near.drop("rank").unionByName(more), order, k).select(
        "query_id", "rank", "vec_id", F.col("score_long").alias("score")
    )
