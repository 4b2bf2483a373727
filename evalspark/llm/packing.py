"""Best-fit packing of tokenised documents into sequences of fixed length.

How many pieces have each length is all that a packing depends on: at most ``capacity`` numbers,
summed by Spark.  From them ``plan`` fixes, for runs of like sequences, which lengths lie in
each, by a linear grouping scheme; Spark numbers the pieces of each length and looks up where the
n-th one goes.  A plan has a few thousand runs at most, however many documents there are.

A null text counts as empty; an empty document still has its end id.  An empty table packs into
nothing.  Rows that repeat are packed as often as they occur.  Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm import store
from evalspark.llm.tokens import array_slabs, at_spaces, encoder

# Lengths above a share of the capacity are grouped and optimised, in so many groups.  Each share
# is tried, and the plan with the fewest sequences taken.
LARGE_SHARES, GROUPS = (1 / 2, 1 / 3, 1 / 8), 64

PIECES = "doc_id long, piece int, start long, length long, ids binary"
Run = tuple[int, list[int]]  # so many sequences that each hold these lengths


def cut_documents(df: DataFrame, tokenizer: str, end_id: int, capacity: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Token pieces of at most ``capacity``; of a longer document only the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, at_spaces)
        for batch in batches:
            for first, texts in array_slabs(batch.column(1)):
                found, counts, _ = own.encode(texts)
                data = np.insert(found, np.cumsum(counts), end_id).astype("<u4").tobytes()
                ends = np.cumsum(counts + 1)
                rows: tuple[list, ...] = ([], [], [], [], [])
                for key, begin, end in zip(batch.column(0).slice(first, len(texts)).to_pylist(), ends - counts - 1, ends, strict=True):
                    edges = [int(begin), *range(int(begin) + ((end - begin) % capacity or capacity), int(end) + 1, capacity)]
                    for number, (a, b) in enumerate(zip(edges, edges[1:])):
                        for column, value in zip(rows, (key, number, a - int(begin), b - a, data[4 * a : 4 * b]), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *map(pa.array, rows[2:4]), pa.array(rows[4], pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, PIECES)


def _grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Equal-cardinality groups of the lengths, longest first: (rounded up length, [[length, count]])."""
    total, out, room = sum(counts.values()), [], 0
    share = -(-total // groups)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = share
            took = min(left, room)
            out[-1][1].append([length, took])
            left -= took
            room -= took
    return out


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, how many of each size) that cover almost all demand in the fewest sequences.

    Column generation for the configuration programme: the basis holds one configuration a
    size, a knapsack over the dual values finds the one that saves most, and the simplex step
    swaps it in, until none saves or a basis comes again, so the steps end without a limit.  The
    fractions are rounded down; what they leave is placed by best fit.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    value = demand / np.diag(basis)
    reach = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits, reach = reach >= 0, np.maximum(reach, 0)
    seen: set[bytes] = set()
    while (now := hashlib.sha256(basis).digest()) not in seen:
        seen.add(now)
        dual = np.linalg.solve(basis.T, np.ones(m))
        best, picks = np.zeros(capacity + 1), []
        for _ in range(int(capacity // sizes.min())):
            gain = np.where(fits, best[reach] + dual[:, None], -1.0)
            pick = gain.argmax(axis=0)
            top = gain[pick, np.arange(capacity + 1)]
            pick = np.where(top > best + 1e-12, pick, -1)
            if (pick < 0).all():
                break
            picks.append(pick)
            best = np.maximum(best, top)
        if best[capacity] <= 1 + 1e-7:
            break
        column, at = np.zeros(m), capacity
        for pick in reversed(picks):
            if pick[at] >= 0:
                column[pick[at]] += 1
                at -= sizes[pick[at]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, value / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        value = np.maximum(value - ratio[out] * step, 0)
        value[out] = ratio[out]
        basis[:, out] = column
    return [(int(x + 1e-6), basis[:, i].astype(int)) for i, x in enumerate(value) if x + 1e-6 >= 1]


class _Open:
    """Runs of like sequences by the room left in each; items go where they leave the least."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.runs: list[list[Run]] = [[] for _ in range(capacity + 1)]

    def add(self, times: int, lengths: list[int]) -> None:
        if times:
            self.runs[self.capacity - sum(lengths)].append((times, lengths))

    def place(self, length: int, count: int) -> None:
        for room in range(length, self.capacity + 1):
            each = room // length
            for times, lengths in self.runs[room] and self._take(room):
                full, rest = divmod(count, each)
                full = min(full, times)
                self.add(full, lengths + [length] * each)
                count -= full * each
                one = int(full < times and 0 < count < each)
                if one:
                    self.add(1, lengths + [length] * count)
                    count = 0
                self.add(times - full - one, lengths)
            if not count:
                return
        full, rest = divmod(count, self.capacity // length)
        self.add(full, [length] * (self.capacity // length))
        self.add(int(rest > 0), [length] * rest)

    def _take(self, room: int) -> list[Run]:
        taken, self.runs[room] = self.runs[room], []
        return taken


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs of sequences that hold every length as often as ``counts`` says."""
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best: list[Run] | None = None
    for share in LARGE_SHARES:
        runs = _plan(counts, capacity, share)
        if best is None or sum(n for n, _ in runs) < sum(n for n, _ in best):
            best = runs
        if sum(n for n, _ in best) == least:
            break
    return best or []


def _plan(counts: dict[int, int], capacity: int, large_share: float) -> list[Run]:
    opened = _Open(capacity)
    opened.add(counts.get(capacity, 0), [capacity])
    rest = {n: c for n, c in counts.items() if n < capacity}
    large = {n: c for n, c in rest.items() if n > capacity * large_share}
    rest = {n: c for n, c in rest.items() if n not in large}
    groups = _grouped(large, GROUPS)
    if groups:
        sizes = np.array([size for size, _ in groups])
        demand = np.array([sum(c for _, c in members) for _, members in groups], float)
        for times, each in _configurations(sizes, demand, capacity):
            slots = [groups[g][1] for g, n in enumerate(each) for _ in range(n)]
            while times:  # the longest documents left in each group take its places
                heads = [next((m for m in slot if m[1]), None) for slot in slots]
                share = [sum(h is x for x in heads) for h in heads]
                now = min([times, *(h[1] // n for h, n in zip(heads, share, strict=True) if h)])
                if not now:  # two places of a group at the end of a length
                    now, heads = 1, []
                    for slot in slots:
                        heads.append(next((m for m in slot if m[1]), None))
                        if heads[-1]:
                            heads[-1][1] -= 1
                else:
                    for h in heads:
                        if h:
                            h[1] -= now
                opened.add(now, [h[0] for h in heads if h])
                times -= now
        for _, members in groups:
            for length, count in members:
                rest[length] = rest.get(length, 0) + count
    for length in sorted(rest, reverse=True):
        if rest[length]:
            opened.place(length, rest[length])
    return [run for runs in opened.runs for run in runs if run[1]]


def _places(runs: list[Run]) -> dict[str, np.ndarray]:
    """For each place of each run: its length, the first number of that length in it, the first sequence, the offset."""
    given: dict[int, int] = {}
    rows, base = [], 0
    for times, lengths in runs:
        offset = 0
        for length in lengths:
            rows.append((length, given.get(length, 0), base, offset))
            given[length] = given.get(length, 0) + times
            offset += length
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T.copy(), strict=True))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id and offset; it has doc_id, piece and length, at most ``capacity``.

    Pieces of one length are numbered in salted parts, so no length needs them in one task.
    ``pieces`` is read three times: pass a written table.
    """
    spark = pieces.sparkSession
    salts = store.partitions_for(spark, 0, 1)
    salt, number = store.unused(pieces, "salt"), store.unused(pieces, "number")
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", salt).agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity)))

    earlier = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", salt, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", salt).orderBy("doc_id", "piece")
    numbered = (
        salted.withColumn(number, F.row_number().over(own).cast("long"))
        .join(before, ["length", salt])
        .withColumn(number, F.col(number) + F.col("before") - 1)
        .select(*pieces.columns, number)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        reach = int(table["first"].max(initial=0)) + 1
        keys = table["length"] * reach + table["first"]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy().astype(np.int64)
            nth = batch.column(batch.num_columns - 1).to_numpy()
            at = np.searchsorted(keys, length * reach + np.minimum(nth, reach - 1), "right") - 1
            sequence = table["sequence"][at] + nth - table["first"][at]
            columns = [*batch.columns[:-1], pa.array(sequence), pa.array(table["offset"][at])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return numbered.mapInArrow(run, store.with_columns(pieces, "sequence_id long, offset long"))


def assemble(placed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and the ids of its pieces in their order (bounded by the capacity)."""
    members = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(members, F.lit(b""), lambda done, piece: F.concat(done, piece["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))
