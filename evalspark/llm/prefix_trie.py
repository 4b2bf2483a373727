"""The trie of conversation prefixes, from sorted sequences and range minima over their common prefixes.

A conversation is its turns in order; turns are equal if role and text are.  Sequences are sorted by
the hashes of their turns, so the conversations that start with a prefix are neighbours.  LCPs
are the turns that a sequence shares with the one before it.  A sparse table answers range minima
over the LCPs of a block, and each candidate prefix finds the left and the right end of its
interval by a binary search of its own; what a node counts are differences of running sums.

Sorted sequences are dealt by range into blocks of bounded size.  Prefixes that reach over the edge of
a block are added up afterwards by a hash of the prefix, so no task needs all members of a node.
Identifiers that end at such a node are hashed one chunk after the other, in order.

Handling: turns are ordered by ``turn``, nulls first, ties by their hash, so repeated rows are turns of
their own; null role or text is empty; rows without a conv_id take no part; other columns are ignored; an empty
table has no nodes.  Texts are reduced to 16 bytes a turn before anything is shuffled; those of one
conversation lie in one row, so a conversation may have some ten million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import store
from evalspark.llm.tokens import flat_ranges

# A block ends at so many turns or conversations; a chunk of identifiers at so many.
BLOCK_TURNS, BLOCK_ROWS, CHUNK = 200_000, 50_000, 50_000
TOKEN = 16  # bytes of a turn's hash
NONE = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

_BLOCKS = "part int, seq long, head binary, tail binary, ids array<long>, sizes array<int>, path binary, words array<long>"
_BLOCK_SCHEMA = pa.schema([
    ("part", pa.int32()), ("seq", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("ids", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int32())), ("path", pa.binary()), ("words", pa.list_(pa.int64())),
])
_FOUND = (
    "kind int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, block long, ends string"
)
_FOUND_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()),
    *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
    ("ends_sha256", pa.string()), ("block", pa.int64()), ("ends", pa.string()),
])
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
CLOSED, OPEN, ENDS = 0, 1, 2


def sequences(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and ``turns``: for each turn in order its hash (hex) and the words of its text."""
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    whole = F.concat(F.length(who).cast("string"), F.lit(":"), who, said)
    rows = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.substring(F.sha2(whole, 256), 1, 2 * TOKEN).alias("token"),
            F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
        ).alias("own"),
    )
    turns = F.transform(F.sort_array(F.collect_list("own")), lambda t: F.struct(t["token"].alias("token"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def with_shared_openings(sequences: DataFrame, every: int = 20, kinds: int = 4) -> DataFrame:
    """Sequences whose first turns come from another conversation.

    Conversation c takes the first h turns of c - c % ``every`` (all if it has fewer, none if it is
    absent) and then its own after its first h; h is crc32(c as text) % ``kinds``.
    """
    home = F.col("conv_id") - F.col("conv_id") % every
    heads = sequences.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("home"), F.slice("turns", 1, kinds - 1).alias("opening"))
    rows = sequences.withColumn("home", home).join(heads, "home", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % kinds).cast("int")
    opening = F.when(F.col("opening").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("opening", F.lit(1), h))
    return rows.select("conv_id", F.concat(opening, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _blocks(sequences: DataFrame) -> DataFrame:
    """Sorted sequences as rows of bounded size, numbered in order by ``block``, each with the paths before and after it."""
    spark = sequences.sparkSession
    rows = sequences.select(
        "conv_id",
        F.unhex(F.array_join(F.col("turns.token"), "")).alias("path"),
        F.col("turns.words").alias("words"),
    )
    parts = store.partitions_for(spark, 1, 1)
    dealt = rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "conv_id", "path", "words")

    def packed(part: int, seq: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        one = pa.Table.from_batches(batches).combine_chunks()
        ids, paths, words = (one.column(k).combine_chunks() for k in (1, 2, 3))
        raw = paths.to_pylist()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // TOKEN
        cells = {
            "part": [part], "seq": [seq], "head": [raw[0]], "tail": [raw[-1]], "ids": [ids], "sizes": [sizes.astype(np.int32)],
            "path": [b"".join(raw)], "words": [words.flatten()],
        }
        return pa.RecordBatch.from_pydict(cells, schema=_BLOCK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, rows, turns = 0, 0, [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(2)), np.int64) // TOKEN)
            begin, base = 0, 0
            while begin < batch.num_rows:
                fits = int(np.searchsorted(sizes, base + BLOCK_TURNS - turns, "right"))
                end = min(max(fits, begin + (not held)), begin + BLOCK_ROWS - rows, batch.num_rows)
                if end > begin:
                    held.append(batch.slice(begin, end - begin))
                    rows, turns = rows + end - begin, turns + int(sizes[end - 1]) - base
                    begin, base = end, int(sizes[end - 1])
                if begin < batch.num_rows:
                    yield packed(part, seq, held)
                    seq, held, rows, turns = seq + 1, [], 0, 0
        if held:
            yield packed(part, seq, held)

    blocks = store.written(dealt.mapInArrow(run, _BLOCKS), "blocks")
    counts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one a partition
    first, total = [], 0
    for part in range(parts + 1):
        first.append(total)
        total += counts.get(part, 0)
    blocks = blocks.withColumn("block", F.array(*map(F.lit, first))[F.col("part")].cast("long") + F.col("seq"))
    before = blocks.select((F.col("block") + 1).alias("block"), F.col("tail").alias("before"))
    after = blocks.select((F.col("block") - 1).alias("block"), F.col("head").alias("after"))
    edges = store.written(blocks.select("block").join(before, "block", "left").join(after, "block", "left"), "edges")
    return blocks.drop("part", "seq", "head", "tail").join(edges, "block")


class Minima:
    """Sparse table: the least of any range of ``values`` from two overlapping powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of values[first .. last], both included."""
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.levels[k][first[own]], self.levels[k][last[own] - (1 << int(k)) + 1])
        return out

    def leftmost(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The least l with values[l + 1 .. at] >= depth throughout."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            to = at - (1 << k)
            own = np.flatnonzero(to >= 0)
            own = own[self.levels[k][to[own] + 1] >= depth[own]]
            at[own] = to[own]
        return at

    def rightmost(self, at: np.ndarray, depth: np.ndarray, end: int) -> np.ndarray:
        """The greatest r below ``end`` with values[at + 1 .. r] >= depth throughout."""
        at = at.copy()
        for k in reversed(range(len(self.levels))):
            to = at + (1 << k)
            own = np.flatnonzero(to < end)
            own = own[self.levels[k][at[own] + 1] >= depth[own]]
            at[own] = to[own]
        return at


def common(one: bytes | None, two: bytes | None) -> int:
    """Turns that two paths share at their start; -1 if one is none."""
    if one is None or two is None:
        return -1
    n = min(len(one), len(two))
    differ = np.flatnonzero(np.frombuffer(one, np.uint8, n) != np.frombuffer(two, np.uint8, n))
    return (int(differ[0]) if len(differ) else n) // TOKEN


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def nodes(block: int, ids: np.ndarray, sizes: np.ndarray, path: bytes, words: np.ndarray, before: bytes | None, after: bytes | None) -> pa.Table:
    """The nodes of one block of sorted sequences, and chunks of the identifiers that end at open ones.

    A node that also has members in a neighbouring block is open: its numbers are this block's part.  The
    root is always open.
    """
    n, tokens = len(ids), np.frombuffer(path, f"V{TOKEN}").view(np.uint64).reshape(-1, 2)
    starts = np.cumsum(sizes) - sizes
    lcp = np.zeros(n + 1, np.int64)
    lcp[0] = common(before, path[: TOKEN * sizes[0]])
    lcp[n] = common(path[TOKEN * starts[-1] :], after)
    shared = np.minimum(sizes[:-1], sizes[1:])
    at = flat_ranges(starts[:-1], shared)
    differ = (tokens[at] != tokens[at + np.repeat(starts[1:] - starts[:-1], shared)]).any(axis=1)
    place = at - np.repeat(starts[:-1], shared)
    found, full = np.where(differ, place, np.repeat(shared, shared)), np.flatnonzero(shared)
    if len(full):
        lcp[full + 1] = np.minimum.reduceat(found, (np.cumsum(shared) - shared)[full])

    # Candidates: each prefix of a sequence that the one before it in the block does not have.
    low = lcp[:n] + 1
    low[0] = 0
    own = sizes - low + 1
    row = np.repeat(np.arange(n), own)
    depth = flat_ranges(low, own)
    offset = np.cumsum(own) - own
    minima = Minima(lcp)
    left = minima.leftmost(row, depth)
    right = minima.rightmost(row, depth, n)
    opened = (depth == 0) | ((left == 0) & (lcp[0] >= depth)) | ((right == n - 1) & (lcp[n] >= depth))

    parent = np.arange(len(row)) - 1
    top = np.flatnonzero((row > 0) & (depth == low[row]))
    above = minima.leftmost(row[top], depth[top] - 1)
    parent[top] = offset[above] + depth[top] - 1 - low[above]
    new = (depth > 0) & ((row > 0) | (depth > lcp[0]))
    children = np.bincount(parent[new], minlength=len(row))

    total = _running(words)
    all_words = total[starts + sizes] - total[starts]
    added = all_words - (total[starts + np.maximum(lcp[:n], 0)] - total[starts])
    leaves = lcp[1:] < sizes
    upto_words, upto_added, upto_leaves = _running(all_words), _running(added), _running(leaves)
    above_words = total[starts[row] + np.maximum(depth - 1, 0)] - total[starts[row]]
    count = right - left + 1
    first = (row > 0) | (depth > lcp[0])
    once = upto_added[right + 1] - upto_added[left + 1] + np.where(first, all_words[row] - above_words, added[row])
    saved = upto_words[right + 1] - upto_words[left] - count * above_words - once

    least = Minima(ids).least(left, right)
    out = {
        "kind": np.where(opened, OPEN, CLOSED), "conv_id": least, "depth": depth, "n_convs": count, "n_children": children,
        "n_leaves": upto_leaves[right + 1] - upto_leaves[left], "saved_tokens": saved,
        "parent_conv_id": least[parent], "block": np.full(len(row), block),
    }
    keys: list[bytes | None] = [None] * len(row)
    for k in np.flatnonzero(opened):
        prefix = path[TOKEN * starts[row[k]] : TOKEN * (starts[row[k]] + depth[k])]
        keys[k] = hashlib.sha256(prefix).digest()
    out["key"] = keys
    out["parent_key"] = [keys[p] if d else None for p, d in zip(parent, depth, strict=True)]

    shas, chunks = [NONE] * len(row), []
    ends = np.append(np.flatnonzero(~(lcp[1:n] == sizes[1:])) + 1, n)  # where another sequence starts
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
        k = offset[a] + sizes[a] - low[a]
        if not opened[k]:
            shas[k] = hashlib.sha256(",".join(map(str, ids[a:b].tolist())).encode()).hexdigest()
            continue
        for c in range(a, b, CHUNK):
            chunks.append((keys[k], ",".join(map(str, ids[c : min(c + CHUNK, b)].tolist()))))
    out |= {"ends_sha256": shas, "ends": [None] * len(row)}
    empty = dict.fromkeys(_FOUND_SCHEMA.names, [None] * len(chunks))
    order = [block * BLOCK_ROWS + k for k in range(len(chunks))]
    more = empty | {"kind": [ENDS] * len(chunks), "key": [c[0] for c in chunks], "block": order, "ends": [c[1] for c in chunks]}
    return pa.concat_tables(pa.Table.from_pydict({c: cells[c] for c in _FOUND_SCHEMA.names}, schema=_FOUND_SCHEMA) for cells in (out, more))


def _ends(chunks: DataFrame) -> DataFrame:
    """key and the hash of its chunks in order, one chunk in memory at a time."""
    dealt = chunks.repartition("key").sortWithinPartitions("key", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([sha.hexdigest()])})

        key, sha = None, None
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if sha is not None and own == key:
                    sha.update(b",")
                else:
                    if sha is not None:
                        yield done()
                    key, sha = own, hashlib.sha256()
                sha.update(text.as_py().encode())
        if sha is not None:
            yield done()

    return dealt.select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


def trie(sequences: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""

    def of(block: pa.Table) -> pa.Table:
        number, ids, sizes, path, words, before, after = (c[0] for c in block.columns)
        ids, sizes, words = (np.asarray(x.values).astype(np.int64) for x in (ids, sizes, words))
        return nodes(number.as_py(), ids, sizes, path.as_py(), words, before.as_py(), after.as_py())

    blocks = _blocks(sequences).select("block", "ids", "sizes", "path", "words", "before", "after")
    found = store.written(blocks.groupBy("block").applyInArrow(of, _FOUND), "nodes")
    parts = found.where(F.col("kind") == OPEN)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.first("parent_key").alias("parent_key"), *sums)
    merged = merged.join(_ends(found.where(F.col("kind") == ENDS)), "key", "left")
    merged = store.written(merged.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE))), "merged")
    root = merged.where("depth = 0").first()
    if root is None:
        return found.select(*_NODE).limit(0)

    closed = found.where(F.col("kind") == CLOSED)
    inner = closed.where("parent_key is null").select(*_NODE)
    outer = closed.where("parent_key is not null").drop("parent_conv_id").select(*merged.columns)
    outer = outer.unionByName(merged)
    under_root = outer.where("depth <= 1").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(root["conv_id"]).cast("long"))
    ).select(*_NODE)
    above = merged.where("depth > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    rest = outer.where("depth > 1").join(above, "parent_key", "left").select(*_NODE)
    return inner.unionByName(under_root).unionByName(rest)
