"""SimHash near-duplicates with bit-sliced comparison.

Each document gets a fingerprint: bit i is set if more than half of its shingles' hashes have
bit i set.  Equal fingerprints are one class.  Classes that may be near each other meet in
buckets, where the fingerprints lie as bit planes: plane i holds bit i of 64 fingerprints a
machine word.  A row is compared with a word of others by exclusive-or with its own bits, and
carry-save counters, themselves bit planes, add up 64 distances at a time; words whose counters
all exceed the radius are given up, as soon as they do.

With a ``similarity`` the links are only candidates.  Their components (groups) hold every pair
that may be similar; in each group the sets of shingles are intersected, and documents are linked
where the Jaccard similarity is at least that.  Fingerprints are then of distinct shingles,
and classes are of equal texts, as different texts may have equal fingerprints.

Buckets come from the fingerprints themselves where the radius is small against the bits: with
two more bands than the radius, two bands of any linked pair are equal, so no link is missed.  For
wide radii they come from minima of hashed shingles (see ``fingerprints``), which find a pair of
similarity 0.8 with probability 0.9999 by 20 tables of four.  A bucket too large for a task is
split into tiles, and each pair of tiles is compared; so is a large group.  A task returns a spanning forest
of its links, never all pairs, and ``components`` joins the forests.

Words: a null or empty text has none and the fingerprint zero, which links like any other; with
fewer words than a shingle the whole sequence counts as one.  Rows that repeat are one class.  A
null id is kept in the result and names no class; a class of null ids only has none.  Extra
columns are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import store
from evalspark.llm.words import mixed

TILE = 8192  # fingerprints of a bucket that one task compares with each other
SET_TILE = 1 << 18  # shingles of a group that one task intersects with each other
SLAB = 8192  # fingerprints laid out as planes at a time
STEP = 16  # planes between two looks at what still counts

SEED = 42


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count, hashed = len(words) - shingle + 1, xxhash.xxh64_intdigest
    spans = zip(starts[:count].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((hashed(whole[a:b], SEED) for a, b in spans), np.uint64, count)


def _majority(hashes: np.ndarray, bits: int) -> bytes:
    """The fingerprint, highest bit first; beyond 64 bits from further hashes of each shingle."""
    if not len(hashes):
        return bytes(bits // 8)
    lanes = np.stack([hashes, *(mixed(hashes, 20 + k) for k in range(1, bits // 64))], axis=1)
    counts = np.zeros(bits, np.int64)
    for begin in range(0, len(lanes), 4096):
        part = lanes[begin : begin + 4096].view(np.uint8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits((2 * counts > len(hashes))[::-1]).tobytes()


def _minima(hashes: np.ndarray, tables: int, rows: int) -> list[int]:
    """One key a table, from ``rows`` minima of differently hashed shingles each."""
    if not len(hashes):
        return [-1] * tables
    factors = mixed(np.arange(tables * rows, dtype=np.uint64), 30) | np.uint64(1)
    least = np.full(tables * rows, 2**64 - 1, np.uint64)
    for begin in range(0, len(hashes), 1024):
        part = hashes[begin : begin + 1024, None] * factors
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0), out=least)
    keys = np.zeros(tables, np.uint64)
    for j in range(rows):
        keys = mixed(keys ^ least[j::rows], j)
    return (keys ^ mixed(np.arange(tables, dtype=np.uint64), 50)).view(np.int64).tolist()


def fingerprints(df: DataFrame, shingle: int, bits: int = 64, tables: int = 0, rows: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, copy (a hash of the text) and fingerprint (binary, highest bit first).

    With ``tables`` of distinct shingles, with that many bucket keys and the number of shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                prints, keys, sizes = [], [], []
                for value in part.column(2).to_pylist():
                    hashes = _shingle_hashes(value, shingle)
                    if tables:
                        hashes = np.unique(hashes)
                        sizes.append(len(hashes))
                    prints.append(_majority(hashes, bits))
                    if tables:
                        keys.append(_minima(hashes, tables, rows))
                columns = [*part.columns[:2], pa.array(prints, pa.binary())]
                if tables:
                    columns += [pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "fingerprint", "keys", "size"][: len(columns)])

    kinds = "doc_id long, copy long, fingerprint binary" + (", keys array<long>, size long" if tables else "")
    return df.select(F.col(doc_id).cast("long"), F.xxhash64(text), F.col(text)).mapInArrow(run, kinds)


def band_keys(prints: DataFrame, bits: int, radius: int) -> DataFrame:
    """``prints`` (id, fingerprint) with keys: each pair of ``radius + 2`` bands."""
    edges = np.linspace(0, bits, radius + 3).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            planes = np.unpackbits(own, axis=1, bitorder="little")
            bands = []
            for number, (a, b) in enumerate(zip(edges, edges[1:])):
                packed = np.zeros((len(planes), -(-(b - a) // 64) * 8), np.uint8)
                packed[:, : -(-(b - a) // 8)] = np.packbits(planes[:, a:b], axis=1, bitorder="little")
                words = packed.view("<u8")
                value = np.zeros(len(planes), np.uint64)
                for k in range(words.shape[1]):
                    value = mixed(value ^ words[:, k], number)
                bands.append(value)
            keys = np.stack([mixed(bands[i] + mixed(bands[j], 3), 4) for i, j in combinations(range(len(bands)), 2)], axis=1)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "fingerprint", "keys"])

    return prints.select("id", "fingerprint").mapInArrow(run, "id long, fingerprint binary, keys array<long>")


def _exceeds(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counted distance is above the radius."""
    more, same = over.copy(), ~over
    for level in reversed(range(len(counter))):
        if radius >> level & 1:
            same &= counter[level]
        else:
            more |= same & counter[level]
            same &= ~counter[level]
    return more


def near_pairs(prints: np.ndarray, begins: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i < j) of the same group within the radius, some at a time.

    ``prints`` has a row of bytes for each fingerprint, ``begins`` the first row of each group.
    """
    n, bits = len(prints), prints.shape[1] * 8
    lanes = np.unpackbits(prints, axis=1, bitorder="little")
    packed = np.packbits(np.pad(lanes, ((0, -n % 64), (0, 0))), axis=0, bitorder="little")
    planes = np.ascontiguousarray(packed.T).view("<u8")  # bit x word of 64 rows
    own = np.ascontiguousarray(lanes.T)
    group_end = np.repeat(np.append(begins[1:], n), np.diff(np.append(begins, n)))
    row = np.arange(n)
    row = row[group_end > row + 1]
    word = (row + 1) // 64
    full = np.uint64(2**64 - 1)
    while len(row):
        for begin in range(0, len(row), 4096):
            i, w = row[begin : begin + 4096], word[begin : begin + 4096]
            low = np.maximum(i + 1 - 64 * w, 0).astype(np.uint64)
            high = np.minimum(group_end[i] - 64 * w, 64).astype(np.uint64)
            alive = (full << low) & (full >> (np.uint64(64) - high))
            counter = [np.zeros(len(i), np.uint64) for _ in range(max(radius.bit_length(), 1))]
            over = np.zeros(len(i), np.uint64)
            for plane in range(0, bits, 2):
                x = planes[plane, w] ^ (np.uint64(0) - own[plane, i].astype(np.uint64))
                y = planes[plane + 1, w] ^ (np.uint64(0) - own[plane + 1, i].astype(np.uint64))
                half = counter[0] ^ x
                carry = (counter[0] & x) | (half & y)
                counter[0] = half ^ y
                for level in range(1, len(counter)):
                    counter[level], carry = counter[level] ^ carry, counter[level] & carry
                over |= carry
                if plane % STEP == STEP - 2 or plane == bits - 2:
                    left = alive & ~_exceeds(counter, over, radius)
                    keep = left != 0
                    if not keep.any():
                        i = i[:0]
                        break
                    if plane == bits - 2 or keep.mean() < 0.7:
                        i, w, alive, over = i[keep], w[keep], left[keep], over[keep]
                        counter = [c[keep] for c in counter]
            if len(i):
                at, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                yield i[at], 64 * w[at] + lane
        word = word + 1
        keep = 64 * word < group_end[row]
        row, word = row[keep], word[keep]


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's smallest known relative) after also joining the pairs a, b."""
    while True:
        one, two = labels[a], labels[b]
        apart = one != two
        if not apart.any():
            return labels
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(labels, np.maximum(one, two), np.minimum(one, two))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Links a < b that connect all ids of ``prints`` (id, fingerprint, keys) that some bucket holds within the radius."""
    spark = prints.sparkSession
    keyed = prints.select(F.explode(F.array_distinct("keys")).alias("key"), "id", "fingerprint")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE)
    tile = F.pmod(F.xxhash64("fingerprint"), "tiles")
    tiled = keyed.join(sizes, "key").withColumn("tiles", tiles).withColumn("tile", tile)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    blocks = tiled.select("key", "tiles", "tile", "id", "fingerprint", other).select(
        "key", (F.least("tile", "other") * F.col("tiles") + F.greatest("tile", "other")).alias("block"), "id", "fingerprint"
    )

    def compare(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        labels = np.arange(len(ids))
        for a, b in near_pairs(prints, np.concatenate([[0], new]), radius):
            labels = _join(labels, a, b)
        linked = np.flatnonzero(labels != np.arange(len(ids)))
        return pa.RecordBatch.from_pydict({"a": ids[labels[linked]], "b": ids[linked]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], axis=1)
            own = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            held.append((keys, np.asarray(batch.column(2)), own))
            if sum(len(k) for k, _, _ in held) < SLAB:
                continue
            keys, ids, own = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if len(new):  # the last bucket may go on in the next batch
                yield compare(keys[: new[-1]], ids[: new[-1]], own[: new[-1]])
                keys, ids, own = keys[new[-1] :], ids[new[-1] :], own[new[-1] :]
            held = [(keys, ids, own)]
        if held:
            yield compare(*(np.concatenate(x) for x in zip(*held, strict=True)))

    parts = store.partitions_for(spark, 0, 1)
    dealt = blocks.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _similar_pairs(sets: list[np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets (of distinct hashes; two empty ones are equal) with at least that Jaccard similarity, by the second."""
    sizes = np.array([len(x) for x in sets])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(number, kind="stable")]
    counts = np.bincount(number, minlength=1)
    starts = np.cumsum(counts) - counts
    ends = np.cumsum(sizes)
    for j in range(1, len(sets)):
        own = number[ends[j] - sizes[j] : ends[j]]
        own = own[counts[own] > 1]
        both = np.bincount(holders[flat_ranges(starts[own], counts[own])], minlength=len(sets))[:j]
        i = np.flatnonzero(both >= least * (sizes[:j] + sizes[j] - both))
        if len(i):
            yield i, np.full(len(i), j)


def similar_links(df: DataFrame, groups: DataFrame, shingle: int, least: float, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Links a < b that connect all ids of a group (id, copy, size, group) whose sets of shingles have at least that similarity."""
    spark = df.sparkSession
    totals = groups.groupBy("group").agg(F.sum(F.greatest("size", F.lit(1))).alias("total"), F.count("*").alias("n")).where("n > 1")
    tiled = groups.join(totals, "group").withColumn("tiles", F.ceil(F.col("total") / SET_TILE)).withColumn("tile", F.pmod(F.xxhash64("id", "copy"), "tiles"))
    own = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    texts = own.join(tiled, ["id", "copy"]).select("id", "copy", "group", "tiles", "tile", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                sets = [np.unique(_shingle_hashes(value, shingle)).view(np.int64) for value in part.column(5).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sets, pa.list_(pa.int64()))], [*part.schema.names[:5], "hashes"])

    sets = texts.mapInArrow(hashed, "id long, copy long, group long, tiles long, tile long, hashes array<long>")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    blocks = sets.select("*", other).select(
        "group", (F.least("tile", "other") * F.col("tiles") + F.greatest("tile", "other")).alias("block"), "id", "copy", "hashes"
    )

    def compare(rows: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        names = sorted(rows)
        ids, labels = np.array([i for i, _ in names], np.int64), np.arange(len(names))
        for a, b in _similar_pairs([rows[name] for name in names], least):
            labels = _join(labels, a, b)
        linked = np.flatnonzero(ids[labels] != ids)
        return pa.RecordBatch.from_pydict({"a": ids[labels[linked]], "b": ids[linked]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, {}
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for row, (group, block, name, copy) in enumerate(keys):
                if at != (group, block):
                    if len(rows) > 1:
                        yield compare(rows)
                    at, rows = (group, block), {}
                rows[name, copy] = np.array(batch.column(4)[row].values, np.int64)
        if len(rows) > 1:
            yield compare(rows)

    parts = store.partitions_for(spark, 0, 1)
    dealt = blocks.repartition(parts, "group", "block").sortWithinPartitions("group", "block", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id reachable, for every id with a link (a < b).

    Large and small stars by turns: every node's larger neighbours, then the smaller ones, are
    hung below the least of them, until nothing changes and each component is one star.
    """
    edges = store.written(edges.select("a", "b").distinct(), "links")
    state = None
    while True:
        whole = (F.sum(F.xxhash64(*columns).cast("decimal(28,0)")) for columns in (("a", "b"), ("b", "a")))
        signature = edges.agg(F.count("*"), *whole).first()
        if signature == state:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
        state = signature
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        large = store.written(large, "stars")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = store.written(small.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "links")


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df``, as they are, with the smallest id of each group of near-duplicates.

    Rows that share an id are one document and leave one row, that of the least text hash.  Rows
    without an id stay.
    """
    found = near_duplicates(df, text=text, doc_id=doc_id, **options)
    key, copy = store.unused(df, "key"), store.unused(df, "copy")
    named = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(key)).agg(F.min("copy").alias(copy))
    same = (F.col(f"`{doc_id}`").cast("long") == F.col(key)) & (F.xxhash64(text) == F.col(copy))
    kept = df.where(F.col(doc_id).isNotNull()).join(named, same, "left_semi").dropDuplicates([doc_id])
    return kept.unionByName(df.where(F.col(doc_id).isNull()))


def near_duplicates(
    df: DataFrame, shingle: int = 3, radius: int = 2, bits: int = 64, tables: int = 0, similarity: float | None = None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest id reachable over links) and copy of every row.

    Without ``tables`` all pairs within the radius are linked; with them, those that share one of
    so many keys (for radii that are wide against the bits).  With ``similarity`` (and tables) these are
    candidates, of which those stay whose sets of shingles have at least that Jaccard similarity.
    """
    prints = store.written(fingerprints(df, shingle, bits, tables, text=text, doc_id=doc_id), "fingerprints")
    least = [F.min("doc_id").alias("id")]
    if similarity is None:
        kind = ["fingerprint"]
        least += [F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys")] if tables else []
    else:
        kind = ["copy", "fingerprint"]
        least += [F.first("keys").alias("keys"), F.first("size").alias("size")]
    classes = store.written(prints.groupBy(*kind).agg(*least), "classes")
    keyed = classes if tables else band_keys(classes.where("id is not null"), bits, radius)
    found = components(links(keyed.where("id is not null"), radius))
    if similarity is not None:
        found = found.select("id", F.col("component").alias("group"))
        found = found.unionByName(found.select(F.col("group").alias("id"), "group")).distinct()
        groups = store.written(classes.select("id", "copy", "size").join(found, "id"), "groups")
        found = components(similar_links(df, groups, shingle, similarity, text, doc_id))
    named = classes.select(*kind, "id").join(found, "id", "left").select(*kind, F.coalesce("component", "id").alias("component_id"))
    return prints.select("doc_id", "copy", "fingerprint").join(named, kind, "left").select(
        "doc_id", "fingerprint", "component_id", "copy"
    )
