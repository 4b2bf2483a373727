"""Approximate nearest neighbours by vantage-point trees, one per shard.

Rows belong to the nearest of a few pivots; a pivot's rows form shards of bounded size, each
with its own tree.  A node splits its rows at the median distance from a vantage point and keeps the
least and greatest distance on each side, so the triangle inequality bounds how near a side can
be to a query.  A side, or a whole pivot, is skipped if ``factor`` times that bound exceeds
the distance of the k-th neighbour found so far: factor 1 gives exact results, larger factors
search less.  Each query first searches some shards of its own pivot, then those that are left.

Every row is indexed; only the pivots come from a sample, of at most ``MOST_PIVOTS`` rows.
Null, zero and non-finite vectors take no part, nor do those of another length than the
commonest, nor rows without an id.  Ties go to the smaller vec_id.  Rows that repeat an id are
candidates of their own; a repeated query is asked once, with its smallest vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import store, vectors
from evalspark.llm.vectors import hits, matrix

SHARD, LEAF, MOST_PIVOTS = 1024, 128, 256
FIRST = 4  # shards of its own pivot that a query searches before any bound is known


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances, from the differences themselves, added up in the order of the components."""
    total = np.zeros((len(queries), len(rows)))
    for x, y in zip(queries.T, rows.T, strict=True):
        total += (x[:, None] - y) ** 2
    return np.sqrt(total)


@dataclass
class Node:
    rows: slice  # of the ordered shard
    point: np.ndarray | None = None  # none in a leaf
    sides: tuple[Node, Node] | None = None
    near: np.ndarray | None = None  # least and greatest distance from the point, for each side


@dataclass
class Shard:
    ids: np.ndarray
    rows: np.ndarray
    root: Node


def build(ids: np.ndarray, rows: np.ndarray) -> Shard:
    """Halves at the median distance by place, so that equal vectors split evenly as well."""
    order = np.argsort(ids, kind="stable")

    def grow(begin: int, end: int) -> Node:
        if end - begin <= LEAF:
            return Node(slice(begin, end))
        own = order[begin:end]
        point = rows[own[distances(rows[own[:1]], rows[own])[0].argmax()]]
        far = distances(point[None, :], rows[own])[0]
        sort = np.argsort(far, kind="stable")
        order[begin:end], far = own[sort], far[sort]
        half = (end - begin) // 2
        sides = grow(begin, begin + half), grow(begin + half, end)
        return Node(slice(begin, end), point, sides, np.array([[far[0], far[half - 1]], [far[half], far[-1]]]))

    root = grow(0, len(ids))
    return Shard(ids[order], rows[order], root)


def nearest(shard: Shard, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of each query's k nearest, no farther than its bound; -1 and inf where there are fewer."""
    best = np.full((len(queries), k), np.inf)
    found = np.full((len(queries), k), -1, np.int64)

    def visit(node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if node.sides is None:
            ids = shard.ids[node.rows]
            far = distances(queries[active], shard.rows[node.rows])
            far[(ids[None, :] == query_ids[active, None]) | (far > bounds[active, None])] = np.inf
            every = np.concatenate([best[active], far], axis=1)
            named = np.concatenate([found[active], np.broadcast_to(ids, far.shape)], axis=1)
            order = np.lexsort((named, every), axis=1)[:, :k]
            best[active], found[active] = np.take_along_axis(every, order, 1), np.take_along_axis(named, order, 1)
            return
        at = distances(queries[active], node.point[None, :])
        low = np.maximum(np.maximum(node.near[:, 0] - at, at - node.near[:, 1]), 0)
        first = (low[:, 1] < low[:, 0]) | ((low[:, 1] == low[:, 0]) & (at[:, 0] > node.near[0, 1]))
        for turn in (0, 1):
            for side in (0, 1):
                own = (first == side) if turn == 0 else (first != side)
                reach = np.minimum(best[active, -1], bounds[active])
                own &= low[:, side] * factor * (1 - 1e-9) <= reach
                visit(node.sides[side], active[own])

    visit(shard.root, np.arange(len(queries)))
    return found, best


def search(rows: DataFrame, queries: DataFrame, k: int, factor: float, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by Euclidean distance."""
    spark = rows.sparkSession
    every = vectors.usable(rows, vector, vec_id).where(F.exists("vector", lambda x: x != 0))
    asked = vectors.usable(queries, vector, vec_id).where(F.exists("vector", lambda x: x != 0))
    asked = store.written(asked.groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    count = every.count()
    wanted = min(max(-(-count // SHARD), 1), MOST_PIVOTS)
    sample = every.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(wanted).collect()
    pivots = np.array([r["vector"] for r in sample]) if sample else np.zeros((1, 0))

    def assign(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                far = distances(matrix(part.column(1)), pivots)
                own = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(own, pa.int32()), pa.array(far[np.arange(len(own)), own])], ["vec_id", "vector", "pivot", "far"]
                )

    placed = every.mapInArrow(assign, "vec_id long, vector array<double>, pivot int, far double")
    cells = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    shards, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for cell in cells:  # at most MOST_PIVOTS
        shards[cell["pivot"]], radius[cell["pivot"]] = -(-cell["n"] // SHARD), cell["radius"]
    first = np.cumsum(shards) - shards
    total = int(shards.sum())
    table = F.array(*(F.struct(F.lit(int(a)).alias("first"), F.lit(int(max(n, 1))).alias("n")) for a, n in zip(first, shards, strict=True)))
    own = table[F.col("pivot")]
    blocked = placed.select((own["first"] + F.pmod(F.xxhash64("vec_id", "vector"), own["n"])).cast("long").alias("block"), "vec_id", "vector")

    def home(queries: np.ndarray, bounds: np.ndarray):
        for pivot in distances(queries, pivots).argmin(axis=1):
            yield first[pivot] + np.arange(min(shards[pivot], FIRST))

    def others(queries: np.ndarray, bounds: np.ndarray):
        far = distances(queries, pivots)
        low = np.maximum(np.maximum(far - radius, (far - far.min(axis=1, keepdims=True)) / 2), 0)
        left = low * factor * (1 - 1e-9) <= bounds[:, None]
        for row, own in zip(left, far.argmin(axis=1), strict=True):
            done = np.where(np.arange(len(pivots)) == own, FIRST, 0)
            yield np.concatenate([np.zeros(0, np.int64), *(first[p] + np.arange(done[p], max(shards[p], done[p])) for p in np.flatnonzero(row))])

    def answer(shard: Shard, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        found, far = nearest(shard, query_ids, queries, bounds, k, factor)
        at, place = np.nonzero(np.isfinite(far))
        return hits(query_ids[at], found[at, place], far[at, place])

    parts = store.partitions_for(spark, total, 1)
    order = [F.asc("score"), F.asc("vec_id")]
    start = asked.withColumn("bound", F.lit(None).cast("double"))
    near = vectors.search(blocked, vectors.route(start, home), build, answer, parts)
    near = store.written(vectors.ranked(near, order, k), "near")
    bound = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    again = vectors.route(asked.join(bound, "vec_id", "left"), others)
    more = vectors.search(blocked, again, build, answer, parts)
    return vectors.ranked(near.drop("rank").unionByName(more), order, k).select("query_id", "rank", "vec_id", "score")
