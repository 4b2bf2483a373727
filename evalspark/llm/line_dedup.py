"""Line dedup by pairwise alignment.

Documents that share a rare line are a pair.  All lines that both hold are aligned by patience
diff, and the aligned blocks go from the later document.  The result is that of all pairs that
share any line; pairs that can take nothing more are left out, so that common lines do not cost
the square of their documents:

* Documents whose lines that others have too are the same, in the same order, align alike.  The first of
  them stands for all; the others lose all these lines to it.
* Of those that stand for others, all holders of a rare line (of at most ``RARE``) are aligned.
* A common line that stays after that is aligned with its first holder, and while it still stays
  with growing samples of its other holders, the last of which holds them all.

In the worst case, common lines that stay in all their documents, the pairs are the square of these
documents.  They are spread by line and document, so no task holds all pairs of a line.

Lines are compared without blanks at their ends; blank lines pair nothing and go with the line
before them.  A null text has no lines and stays null.  Documents with a null id keep everything and
pair with none.  Rows with the same id and text are one document; with the same id
and different texts, the order of their hashes decides which is the earlier.  An empty table gives
an empty result.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import store

RARE = 4  # a line with at most so many holders is rare
SAMPLE = 16  # holders of a common line in the first sample; each later one has so many times more
SPREAD = 4096  # documents of a line that meet its sample in one key

LINES = "doc struct<id: bigint, copy: bigint>, line bigint, places array<int>"
DOCUMENT = "doc struct<id: bigint, copy: bigint>, line bigint"
BLOCKS = "earlier struct<id: bigint, copy: bigint>, later struct<id: bigint, copy: bigint>, blocks array<array<int>>"


def split_lines(text: str) -> list[str]:
    return text.split("\n")


def _increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence of distinct values."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
        ends[at : at + 1] = [i]
        back.append(ends[at - 1] if at else -1)
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(one: list[int], two: list[int]) -> list[tuple[int, int]]:
    """Index pairs of equal items, rising in both: common ends, then items unique in both, then between them."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(one), 0, len(two))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and one[a] == two[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == two[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        left, right = Counter(one[a:b]), Counter(two[c:d])
        place = {v: c + k for k, v in enumerate(two[c:d]) if right[v] == 1 and left.get(v) == 1}
        common = [(a + k, place[v]) for k, v in enumerate(one[a:b]) if v in place]
        kept = [common[k] for k in _increasing([j for _, j in common])]
        if kept:
            edges = [(a - 1, c - 1), *kept, (b, d)]
            pairs += kept
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(pairs)


def _blocks(one: tuple[list[int], list[int]], two: tuple[list[int], list[int]]) -> list[list[int]]:
    """Aligned runs of lines as [first in the earlier, first in the later, how many], from lines and their places."""
    both = set(one[0]) & set(two[0])
    sides = [[(p, k) for k, p in zip(*side, strict=True) if k in both] for side in (one, two)]
    out: list[list[int]] = []
    for i, j in patience(*([k for _, k in side] for side in sides)):
        at = sides[0][i][0], sides[1][j][0]
        if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == at:
            out[-1][2] += 1
        else:
            out.append([*at, 1])
    return out


def _document(text: str, doc_id: str):
    return F.struct(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("copy"))


def lines_of(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc, hash of each distinct line that is not blank, and its places among such lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows, hashes, places = [], [], []
                for row, value in enumerate(part.column(1).to_pylist()):
                    own: dict[int, list[int]] = {}
                    stripped = (line.strip() for line in split_lines(value))
                    for place, line in enumerate(x for x in stripped if x):
                        own.setdefault(xxhash.xxh64_intdigest(line) - 2**63, []).append(place)
                    rows += [row] * len(own)
                    hashes += own
                    places += own.values()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(hashes, pa.int64()), pa.array(places, pa.list_(pa.int32()))],
                    ["doc", "line", "places"],
                )

    known = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return known.select(_document(text, doc_id).alias("doc"), F.col(text)).mapInArrow(run, LINES)


def _aligned(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """earlier, later and their aligned blocks, for pairs of documents."""
    sides = [sequences.select(F.col("doc").alias(name), F.struct("lines", "places").alias(s)) for name, s in (("earlier", "a"), ("later", "b"))]
    together = pairs.join(sides[0], "earlier").join(sides[1], "later").select("earlier", "later", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                cells = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                blocks = [_blocks((a["lines"], a["places"]), (b["lines"], b["places"])) for a, b in cells]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(blocks, pa.list_(pa.list_(pa.int32())))], ["earlier", "later", "blocks"]
                )

    return together.mapInArrow(run, BLOCKS)


def _places(found: DataFrame, doc: str, places: str) -> DataFrame:
    """Each later document and the set of its places in blocks: no more than it has lines, whatever its pairs."""
    each = F.flatten(F.transform("blocks", lambda b: F.sequence(b[1], b[1] + b[2] - 1)))
    return found.select(F.col("later").alias(doc), F.explode(each).alias("place")).groupBy(doc).agg(F.collect_set("place").alias(places))


def _staying(sequences: DataFrame, found: DataFrame) -> DataFrame:
    """doc and each of its distinct lines that has a place outside the blocks found so far."""
    marked = sequences.join(_places(found, "doc", "gone"), "doc", "left").select("doc", "lines", "places", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows, lines = [], []
                for row, (own, places, gone) in enumerate(zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)):
                    taken = set(gone or [])
                    left = {k for k, p in zip(own, places, strict=True) if p not in taken}
                    rows += [row] * len(left)
                    lines += left
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(lines, pa.int64())], ["doc", "line"])

    return marked.mapInArrow(run, DOCUMENT)


def aligned_blocks(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """earlier, later (id and copy) and their aligned blocks: [line in earlier, line in later, lines].

    Pairs whose blocks others cover are left out where that is known beforehand.
    """
    # Written, as it is read twice and costs more to find than to read.
    lines = store.written(lines_of(df, text, doc_id), "lines")
    ends = (F.min("doc.id").alias("first"), F.max("doc.id").alias("last"), F.min("doc.copy").alias("low"), F.max("doc.copy").alias("high"))
    holders = lines.groupBy("line").agg(*ends).where("first <> last OR low <> high")
    # Written, so that both sides of the join are plain shuffles, whose hot lines Spark can split.
    holders = store.written(holders.select("line"), "holders")
    each = F.explode("places").alias("place")
    placed = lines.join(holders, "line").select("doc", "line", each).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("place", "line"))).alias("own"))
    alike = F.sha2(F.array_join(F.col("own.line").cast("array<string>"), " "), 256)
    sequences = placed.select("doc", F.col("own.line").alias("lines"), F.col("own.place").alias("places"), alike.alias("alike"))
    sequences = store.written(sequences, "sequences")
    heads = store.written(sequences.groupBy("alike").agg(F.min("doc").alias("head")), "heads")
    repeats = sequences.join(heads, "alike").where("doc <> head").select(F.col("head").alias("earlier"), F.col("doc").alias("later"))
    found = [store.written(_aligned(repeats, sequences), "blocks")]

    sequences = store.written(sequences.join(heads.select(F.col("head").alias("doc")), "doc", "left_semi").drop("alike"), "sequences")
    entries = sequences.select("doc", F.explode(F.array_distinct("lines")).alias("line"))
    counts = entries.groupBy("line").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where("n > 1")
    counts = store.written(counts, "counts")
    most = counts.agg(F.max("n")).first()[0] or 0
    # A holder's rank among those of its line, about: n times a number in [0, 1) of its own.
    rank = F.pmod(F.xxhash64("doc.id", "doc.copy", "line"), F.lit(1 << 40)) / float(1 << 40) * F.col("n")
    ranked = store.written(entries.join(counts, "line").select("line", "doc", "n", "first", rank.alias("rank")), "ranked")
    rare = ranked.where(F.col("n") <= RARE)
    later = rare.select("line", F.col("doc").alias("later"))
    pairs = rare.select("line", F.col("doc").alias("earlier")).join(later, "line").where("earlier < later").select("earlier", "later").distinct()
    found.append(store.written(_aligned(pairs, sequences), "blocks"))
    common = counts.where(F.col("n") > RARE)
    parts = F.ceil(F.col("n") / SPREAD)

    def staying(before: DataFrame | None = None) -> DataFrame:
        """Common lines that stay.  Blocks only grow, so documents that had none of them ``before`` have none now."""
        own, so_far = sequences, functools.reduce(DataFrame.unionByName, found[1:])
        if before is not None:
            documents = before.select("later").distinct()
            own = own.join(documents.withColumnRenamed("later", "doc"), "doc", "left_semi")
            so_far = so_far.join(documents, "later", "left_semi")
        part = F.pmod(F.xxhash64("doc"), parts).alias("part")
        left = _staying(own, so_far).join(common, "line").where("first < doc")
        return store.written(left.select("line", "first", part, F.col("doc").alias("later")), "staying")

    left = None
    if most > RARE:
        left = staying()
        pairs = left.select(F.col("first").alias("earlier"), "later").distinct()
        found.append(store.written(_aligned(pairs, sequences), "blocks"))
    low, high = 0, SAMPLE
    while RARE < most and low < most:
        left = staying(left)
        if left.isEmpty():
            break
        sample = ranked.where((F.col("n") > RARE) & (F.col("rank") >= low) & (F.col("rank") < high) & (F.col("doc") != F.col("first")))
        each = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")
        sample = sample.select("line", F.col("doc").alias("earlier"), each)
        pairs = left.join(sample, ["line", "part"]).where("earlier < later").select("earlier", "later").distinct()
        found.append(store.written(_aligned(pairs, sequences), "blocks"))
        low, high = high, high * SAMPLE
    return functools.reduce(DataFrame.unionByName, found)


def _without(text: str, gone: set[int]) -> tuple[str, int, int]:
    """The text without these of its lines that are not blank; how many of these there were, and went."""
    kept, place, drop = [], -1, False
    for line in split_lines(text):
        if line.strip():
            place += 1
            drop = place in gone
        if not drop:
            kept.append(line)
    return "\n".join(kept) if gone else text, place + 1, len(gone)


def remove_blocks(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with every text cleaned, and n_lines and n_removed (lines that are not blank).

    The two names get underscores in front where ``df`` has them.
    """
    counts = [store.unused(df, "n_lines"), store.unused(df, "n_removed")]
    key, gone = store.unused(df, "document"), store.unused(df, "gone")
    found = _places(aligned_blocks(df, text, doc_id), key, gone)
    marked = df.withColumn(key, _document(text, doc_id)).join(found, key, "left").select(*(F.col(f"`{c}`") for c in df.columns), gone)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                cells = [
                    (None, 0, 0) if value is None else _without(value, set(own or []))
                    for value, own in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)
                ]
                columns = list(part.columns[:-1])
                columns[at] = pa.array([c[0] for c in cells], pa.string())
                numbers = [pa.array([c[k] for c in cells], pa.int64()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*columns, *numbers], [*part.schema.names[:-1], *counts])

    return marked.mapInArrow(run, store.with_columns(df, ", ".join(f"`{c}` long" for c in counts)))
