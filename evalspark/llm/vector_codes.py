"""Codes for vectors: each part of a vector becomes the index of the nearest entry of that part's codebook.

Components are integers (floor of ``scale`` times the component) and so are entries, so all distances are
exact.  Codebooks start as the parts of the rows with the smallest ids and are refined by Lloyd's rounds:
assign every part to its nearest entry, then move each entry to the floor of the mean of its parts.
Entries stop moving long before the last round.  A part whose own entry stayed where it was therefore compares
only the entries that moved with its stored distance; all other parts are compared with every entry.
Ties go to the lower index either way.

Each round writes the state of all rows (components, codes and distances) to the shared folder, and
partitions send sums and counts of each entry, whose number does not depend on the rows.

Handling: vectors that are null or hold null or non-finite components are left out, and so are those
of another length than the commonest, which must divide into ``parts``.  Rows that repeat an id are rows of
their own; null ids come last; among equal ids the smaller vector comes first.  With fewer rows than
entries there are as many entries as rows; without rows there is no result.  Components so large that an
error might not fit a long are refused with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import store


def _cells(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    bounds = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.ascontiguousarray(rows).ravel(), pa.int64()))


def squares(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every entry."""
    total = np.zeros((len(rows), len(entries)), np.int64)
    for x, y in zip(rows.T, entries.T, strict=True):
        total += (x[:, None] - y) ** 2
    return total


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower one of a tie, and the squared distance to it."""
    far = squares(rows, entries)
    code = far.argmin(axis=1)
    return code, far[np.arange(len(rows)), code]


def reassign(rows: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``nearest`` gives, from the codes and distances of the round before and the entries that moved since.

    An entry that stayed has the distance it had, so where a part's own entry stayed no other that
    stayed can beat it.
    """
    code, far = code.copy(), far.copy()
    lost = moved[code]
    if lost.any():
        code[lost], far[lost] = nearest(rows[lost], entries)
    active, kept = np.flatnonzero(moved), np.flatnonzero(~lost)
    if len(active) and len(kept):
        best, near = nearest(rows[kept], entries[active])
        best = active[best]
        wins = (near < far[kept]) | ((near == far[kept]) & (best < code[kept]))
        code[kept[wins]], far[kept[wins]] = best[wins], near[wins]
    return code, far


def whole(df: DataFrame, scale: int, parts: int, vector: str, vec_id: str, label: str) -> DataFrame:
    """vec_id, label and ``cells``, the integer components, of the rows that take part."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("vector is not null").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), "length").first()
    length = commonest["length"] if commonest else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components do not divide into {parts} equal parts")
    # Distances stay below 2**62, and so does their sum over the parts.
    most = int((2**60 / max(length, 1)) ** 0.5) / scale
    refused = F.raise_error(F.lit(f"components of {most:g} or more have no exact error")).cast("long")
    cells = F.transform("vector", lambda x: F.when(F.abs(x) < most, F.floor(x * scale)).otherwise(refused))
    return rows.where(F.size("vector") == length).select("vec_id", "label", cells.alias("cells"))


def _start(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks by part, entry and position: the rows with the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "cells").limit(entries).select("cells").collect()
    cells = np.array([r["cells"] for r in first], np.int64).reshape(len(first), parts, -1)
    return cells.transpose(1, 0, 2)


def _assigned(state: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The state with new codes and distances; without old ones every entry is compared."""
    known = "codes" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = _cells(batch.column(2)).reshape(batch.num_rows, len(books), -1)
            codes = np.zeros((batch.num_rows, len(books)), np.int64)
            far = np.zeros_like(codes)
            old = [_cells(batch.column(k)) for k in (3, 4)] if known else None
            for p, book in enumerate(books):
                if old:
                    codes[:, p], far[:, p] = reassign(cells[:, p], book, moved[p], old[0][:, p], old[1][:, p])
                else:
                    codes[:, p], far[:, p] = nearest(cells[:, p], book)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(codes), _lists(far)], ["vec_id", "label", "cells", "codes", "far"])

    schema = state if known else state.withColumns({c: F.lit(None).cast("array<long>") for c in ("codes", "far")})
    return state.mapInArrow(run, schema.schema)


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry at the floor of the mean of its parts; entries without parts stay."""
    parts, entries, width = books.shape
    shape = (parts, entries, width + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                cells, codes = _cells(batch.column(0)).reshape(batch.num_rows, parts, -1), _cells(batch.column(1))
                for p in range(parts):
                    np.add.at(total[p, :, 0], codes[:, p], 1)
                    np.add.at(total[p, :, 1:], codes[:, p], cells[:, p])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "value": pa.array(total.ravel()[at], pa.int64())})

    found = state.select("cells", "codes").mapInArrow(run, "at long, value long")
    total = [0] * (parts * entries * (width + 1))
    for row in found.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        total[row["at"]] = int(row["value"])
    out = books.copy()
    for k in range(parts * entries):
        count, *sums = total[k * (width + 1) : (k + 1) * (width + 1)]
        if count:
            out[k // entries, k % entries] = [s // count for s in sums]
    return out


def train(rows: DataFrame, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """The rows with codes and distances, and the codebooks, after so many rounds and a last assignment."""
    books = _start(rows, parts, entries)
    state, moved = rows, np.ones(books.shape[:2], bool)
    for _ in range(rounds):
        state = store.written(_assigned(state, books, moved), "codes")
        new = _moved(state, books)
        moved, books = (new != books).any(axis=2), new
    return store.written(_assigned(state, books, moved), "codes"), books


def compress(
    df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every row that takes part.

    ``code`` has two hex digits a part; ``error`` is the squared distance over all parts, ``label_error``
    its sum over the rows with an equal label (nulls together).
    """
    rows = store.written(whole(df, scale, parts, vector, vec_id, label), "cells")
    if rows.isEmpty():
        return rows.selectExpr("vec_id", "label", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    state, books = train(rows, parts, entries, rounds)
    shown = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = state.select(
        "vec_id", "label",
        F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        F.aggregate("far", F.lit(0).cast("long"), lambda a, b: a + b).alias("error"),
    )
    # Written, so that both sides of the join are plain shuffles, whose hot labels Spark can split.
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = store.written(sums, "labels")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")
    return joined.withColumn("codebooks_sha256", F.lit(shown))


def oracle_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in SQL for the table ``embeddings``."""
    steps = [f"""v AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
        list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), p AS MATERIALIZED (
    SELECT rid, part, q[part * len(q) // {parts} + 1 : (part + 1) * len(q) // {parts}] AS x FROM v, range({parts}) AS r(part)
), c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x AS y FROM p WHERE rid <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
    SELECT rid, part, entry, x, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
    FROM p JOIN c{k} USING (part) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY far, entry) = 1
)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
    SELECT c.part, c.entry, coalesce(n.y, c.y) AS y FROM c{k} c LEFT JOIN (
        SELECT part, entry, list(m ORDER BY place) AS y FROM (
            SELECT part, entry, place, floor(sum(x[place]) / count(*))::BIGINT AS m FROM a{k}, unnest(range(1, len(x) + 1)) AS u(place) GROUP BY ALL
        ) GROUP BY part, entry
    ) n ON n.part = c.part AND n.entry = c.entry
)""")
    return "WITH " + ", ".join(steps) + f""", b AS (
    SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}
), e AS (
    SELECT rid, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM v JOIN e USING (rid), b"""
