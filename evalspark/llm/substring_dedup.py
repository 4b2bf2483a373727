"""Exact removal of repeated word windows by difference-cover anchors.

A cover of a period holds residues such that every distance between two places, modulo the
period, is a difference of two of them.  So of two equal windows, wherever they lie in their
documents, some offset is a cover place in both, and the short run of words there, the anchor,
is equal as well.  Only anchors (three of seven places) are compared across the corpus; runs
that other documents share as well are then extended to whole windows, and only those windows
are compared.  128-bit hashes stand for windows; those of anchors only choose what is compared.

Work goes by groups of documents of bounded size.  A group sends each bucket of the hash range
its distinct hashes in order, as one block, and is answered by one bit for each, so a passage
that a third of all documents share costs each group one hash, and no list of its places is
ever made.  Texts are shuffled once, to their groups; the three passes read the same shuffle.

A null text has no words.  A document with a null id takes no part: nothing is removed from it
and it removes nothing.  Rows that repeat an id are judged alike, never against each other.  Extra
columns are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm import store
from evalspark.llm.tokens import flat_ranges
from evalspark.llm.words import Words, runs, words_of

PERIOD, COVER = 7, (0, 1, 3)
# Bytes of text for each partition, group and bucket.
PARTITION_BYTES, GROUP_BYTES, BUCKET_BYTES = 24 << 20, 2 << 20, 8 << 20

BLOCKS = "bucket int, grp int, hashes binary, owners binary"
ANSWERS = "grp int, bucket int, bits binary"
KEPT = "doc_id long, text string, n_words long, n_removed long"


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The hash range in equal parts, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins among sorted ones."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_keys[0]), bool)
    new[0] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


class _Group:
    """The documents of one group, their anchors and windows."""

    def __init__(self, rows: pa.Table, window: int):
        self.keys = rows.column("doc_id").combine_chunks()
        self.words: Words = words_of(rows.column("text"))
        self.window, self.length = window, window - PERIOD + 1
        text = self.words.text_of()
        self.place = np.arange(len(text)) - self.words.first[text]
        self.left = self.words.counts[text] - self.place  # words from here to the end of the text
        known = np.asarray(self.keys.is_valid())
        self.ids = np.asarray(self.keys.fill_null(0), np.int64)
        whole = (self.words.counts >= window) & known
        self.usable = whole[text]
        self.owner = self.ids[text]
        self.hashes = self.words.hashes()

    def anchors(self) -> None:
        """Distinct anchors in order, the places of each, and whether documents here share it."""
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(self.usable & cover[self.place % PERIOD] & (self.left >= self.length))
        found = runs(self.hashes, self.length)[at]
        order = np.argsort(found, kind="stable")
        self.anchor_at, found = at[order], found[order]
        begin = _starts(found)
        self.anchor = found[begin]
        self.anchor_count = np.diff(np.append(begin, len(found)))
        owner = self.owner[self.anchor_at]
        self.anchor_here = np.minimum.reduceat(owner, begin) < np.maximum.reduceat(owner, begin) if len(begin) else np.zeros(0, bool)

    def windows(self, shared: np.ndarray) -> None:
        """Windows around shared anchors: distinct ones in order, the places and first owner of each."""
        near = np.zeros(len(self.place) + 1, np.int64)
        near[self.anchor_at[np.repeat(shared, self.anchor_count)] + 1] = 1
        near = np.cumsum(near)
        at = np.flatnonzero(self.usable & (self.left >= self.window))
        at = at[near[at + PERIOD] > near[at]]
        one, two = runs(self.hashes, self.window, 1)[at], runs(self.hashes, self.window, 2)[at]
        order = np.lexsort((two, one))
        self.window_at, one, two = at[order], one[order], two[order]
        begin = _starts(one, two)
        self.one, self.two = one[begin], two[begin]
        self.window_count = np.diff(np.append(begin, len(one)))
        self.first_owner = np.minimum.reduceat(self.owner[self.window_at], begin) if len(begin) else np.zeros(0, np.int64)

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Words in a window that a smaller id has too: ``repeated`` in other groups, or in this one."""
        gone = np.repeat(repeated, self.window_count)
        gone |= self.owner[self.window_at] > np.repeat(self.first_owner, self.window_count)
        edges = np.zeros(len(self.place) + 1, np.int64)
        np.add.at(edges, self.window_at[gone], 1)
        np.add.at(edges, self.window_at[gone] + self.window, -1)
        return np.cumsum(edges[:-1]) > 0


def _blocks(group: int, hashes: np.ndarray, buckets: int, *columns: np.ndarray) -> dict[str, list]:
    """One row for each bucket: its hashes (and the other columns) in order."""
    cuts = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1, dtype=np.uint64))
    filled = np.flatnonzero(cuts[1:] > cuts[:-1])
    cells = [[c[cuts[b] : cuts[b + 1]].tobytes() for b in filled] for c in columns]
    return {"bucket": filled.tolist(), "grp": [group] * len(filled), "hashes": cells[0],
            "owners": cells[1] if len(cells) > 1 else [b""] * len(filled)}


def _table(rows: dict[str, list]) -> pa.Table:
    return pa.table({
        k: pa.array(v, pa.binary() if k in ("hashes", "owners", "bits") else pa.int32()) for k, v in rows.items()
    })


def _bits(answers: pa.Table, sizes: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The answers of all buckets, one bit for each hash in order."""
    by = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    parts = [np.unpackbits(np.frombuffer(by[b], np.uint8), count=n) for b, n in zip(buckets.tolist(), sizes.tolist(), strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _sent(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sent to each bucket, the buckets)."""
    got, sizes = np.unique(_bucket(hashes, buckets), return_counts=True)
    return sizes, got


def remove_repeats(df: DataFrame, window: int = 13, text: str = "text", doc_id: str = "doc_id", layout: bool = False) -> DataFrame:
    """Per document: its words that no earlier document's window repeats, joined by one space.

    Columns doc_id, text, n_words, n_removed.  ``window`` is at least the period.  With ``layout``
    each kept word keeps the white space after it, and ``rest`` is a struct of all other columns.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kinds = T.StructType.fromDDL(KEPT)
    if layout:
        others = [F.col(f"`{c}`") for c in df.columns if c not in (text, doc_id)]
        rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct(*others).alias("rest"))
        kinds = kinds.add("rest", rows.schema["rest"].dataType)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = store.partitions_for(spark, size, PARTITION_BYTES)
    groups, buckets = max(-(-size // GROUP_BYTES), 1), max(-(-size // BUCKET_BYTES), 1)
    grouped = rows.withColumn(
        "grp", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(groups)).cast("int")
    ).repartition(parts, "grp")

    def anchors(rows: pa.Table) -> pa.Table:
        own = _Group(rows, window)
        own.anchors()
        return _table(_blocks(rows.column("grp")[0].as_py(), own.anchor, buckets, own.anchor))

    def shared(rows: pa.Table) -> pa.Table:
        """For each block, which of its hashes another group sent as well."""
        cells = [np.frombuffer(c, np.uint64) for c in rows.column("hashes").to_pylist()]
        _, where, count = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
        return _answers(rows, [len(c) for c in cells], count[where] > 1)

    def windows(rows: pa.Table, answers: pa.Table) -> pa.Table:
        own, group = _Group(rows, window), rows.column("grp")[0].as_py()
        own.anchors()
        is_shared = _bits(answers, *_sent(own.anchor, buckets)) | own.anchor_here
        own.windows(is_shared)
        keys = np.stack([own.one, own.two], axis=1)
        out = _blocks(group, own.one, buckets, keys, own.first_owner)
        # Which anchors are shared comes back to this group with the answers.
        for name, value in (("bucket", -1 - group), ("grp", group), ("hashes", np.packbits(is_shared).tobytes()), ("owners", b"")):
            out[name].append(value)
        return _table(out)

    def earlier(rows: pa.Table) -> pa.Table:
        """For each block, which of its windows have a smaller owner in another group."""
        if rows.column("bucket")[0].as_py() < 0:
            return _table({"grp": rows.column("grp").to_pylist(), "bucket": [-1] * len(rows), "bits": rows.column("hashes").to_pylist()})
        cells = [np.frombuffer(c, np.uint64).reshape(-1, 2) for c in rows.column("hashes").to_pylist()]
        keys = np.concatenate(cells)
        owner = np.concatenate([np.frombuffer(c, np.int64) for c in rows.column("owners").to_pylist()])
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        begin = _starts(keys[order, 0], keys[order, 1])
        least = np.empty(len(owner), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(owner[order], begin), np.diff(np.append(begin, len(owner))))
        return _answers(rows, [len(c) for c in cells], least < owner)

    def kept(rows: pa.Table, answers: pa.Table) -> pa.Table:
        own = _Group(rows, window)
        own.anchors()
        back = answers.column("bucket").to_pylist().index(-1)
        bits = np.frombuffer(answers.column("bits")[back].as_py(), np.uint8)
        own.windows(np.unpackbits(bits, count=len(own.anchor)).astype(bool))
        gone = own.covered(_bits(answers, *_sent(own.one, buckets)))
        out = _joined(own, ~gone, layout)
        return out.append_column("rest", rows.column("rest")) if layout else out

    answers = grouped.groupBy("grp").applyInArrow(anchors, BLOCKS).groupBy("bucket").applyInArrow(shared, ANSWERS)
    asked = grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(windows, BLOCKS)
    answers = asked.groupBy("bucket").applyInArrow(earlier, ANSWERS)
    return grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(kept, kinds)


def _answers(rows: pa.Table, sizes: list[int], bits: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    cells = [np.packbits(bits[b - n : b]).tobytes() for n, b in zip(sizes, ends, strict=True)]
    return _table({"grp": rows.column("grp").to_pylist(), "bucket": rows.column("bucket").to_pylist(), "bits": cells})


def _joined(own: _Group, kept: np.ndarray, layout: bool) -> pa.Table:
    """The kept words of every document, joined by one space or (``layout``) with what stood after each."""
    words = own.words
    at = np.flatnonzero(kept)
    n_kept = np.diff(np.concatenate([[0], np.cumsum(kept)])[words.first])
    stops = words.ends + 1
    if layout:
        stops = np.append(words.starts[1:], len(words.data))
        last = words.first[1:][words.counts > 0] - 1
        stops[last] = words.text_ends[words.counts > 0]
    sizes = (stops - words.starts)[at]
    where = np.minimum(flat_ranges(words.starts[at], sizes), max(len(words.data) - 1, 0))
    out = words.data[where] if len(at) else np.zeros(0, np.uint8)
    ends = np.cumsum(sizes)
    if not layout:
        out[ends - 1] = 32
    edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_kept)])]
    data = out.tobytes()
    cut = 0 if layout else 1
    texts = [data[a : max(a, b - cut)].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({
        "doc_id": own.keys, "text": pa.array(texts, pa.string()),
        "n_words": words.counts.astype(np.int64), "n_removed": words.counts - n_kept,
    })
