"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first.  Level 0 holds the lowest chunk of every
id; level k + 1 holds the next chunk of those ids of level k that go on, in their order.  A
bitmap per level says which go on, and a rank directory counts the set bits before every block
of 512, so one token is found by one byte, one bitmap block and one directory entry a level:
no other token is decoded.  Documents lie in ascending doc_id order, within a file and from
file to file, and each file has an index of its documents.

Null ids come first, repeated ids lie next to each other in the order of their texts, a null
text is empty, and an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm import store
from evalspark.llm.tokens import array_slabs, between_spaces, encoder

MAGIC, BLOCK = b"DACTOK01", 512
FILE_BYTES = 32 << 20  # of text for each file
_HEAD = struct.Struct("<8sqqqq")  # magic, documents, of these with null id, tokens, levels

FILES = "file string, file_no int, n_docs long, n_tokens long"
TOKENS = "doc_id long, start long, n_tokens long, ids binary"


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap of those that go on, set bits before each block) of every level."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest >> np.uint32(8)
        on = more > 0
        bits = np.packbits(on, bitorder="little")
        counted = np.concatenate([[0], np.cumsum(np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.int64))]) \
            if len(on) else np.zeros(1, np.int64)
        levels.append(((rest & np.uint32(255)).astype(np.uint8), bits, counted.astype("<i8")))
        rest = more[on]
    return levels


class Addressed:
    """Reads one file: ``token(i)`` by seeking, ``tokens(a, b)`` for a range, and its documents."""

    def __init__(self, source):
        self.source = source
        magic, self.n_docs, self.n_null, self.n_tokens, n_levels = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        sizes = np.frombuffer(self._read(_HEAD.size, 8 * n_levels), "<i8")
        at = _HEAD.size + 8 * n_levels
        self.index_at = at
        at += 8 * self.n_docs + 8 * (self.n_docs + 1)
        self.levels = []
        for n in map(int, sizes):
            bits, ranks = -(-n // 8), 8 * (-(-n // BLOCK) + 1)
            self.levels.append((n, at, at + n, at + n + bits))
            at += n + bits + ranks

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids in order and where each document starts, with the number of tokens at the end."""
        ids = np.frombuffer(self._read(self.index_at, 8 * self.n_docs), "<i8").tolist()
        starts = np.frombuffer(self._read(self.index_at + 8 * self.n_docs, 8 * (self.n_docs + 1)), "<i8")
        return [None] * self.n_null + ids[self.n_null :], starts

    def _rank(self, level: int, i: int) -> int:
        n, _, bits_at, ranks_at = self.levels[level]
        block = i // BLOCK
        before = int(np.frombuffer(self._read(ranks_at + 8 * block, 8), "<i8")[0])
        first = block * BLOCK // 8
        bits = np.unpackbits(np.frombuffer(self._read(bits_at + first, i // 8 - first + 1), np.uint8), bitorder="little")
        return before + int(bits[: i - block * BLOCK].sum())

    def token(self, i: int) -> int:
        value = 0
        for level, (n, at, bits_at, _) in enumerate(self.levels):
            if not 0 <= i < n:
                raise IndexError(i)
            value |= self._read(at + i, 1)[0] << (8 * level)
            if not self._read(bits_at + i // 8, 1)[0] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """Ids begin..end-1; each level is read only where these ids have chunks."""
        values = np.zeros(end - begin, np.uint32)
        where = np.arange(end - begin)
        for level, (n, at, bits_at, _) in enumerate(self.levels):
            if begin >= end:
                break
            values[where] |= np.frombuffer(self._read(at + begin, end - begin), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            first = begin // 8
            bits = np.unpackbits(np.frombuffer(self._read(bits_at + first, -(-end // 8) - first), np.uint8), bitorder="little")
            on = bits[begin - 8 * first : end - 8 * first].astype(bool)
            begin = self._rank(level, begin) if on.any() else 0
            end = begin + int(on.sum())
            where = where[on]
        return values


def _file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    levels = pack(ids)
    n_null = sum(i is None for i in doc_ids)
    known = np.array([0 if i is None else i for i in doc_ids], "<i8")
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    head = _HEAD.pack(MAGIC, len(doc_ids), n_null, len(ids), len(levels))
    sizes = np.array([len(chunks) for chunks, _, _ in levels], "<i8")
    return b"".join([head, sizes.tobytes(), known.tobytes(), starts.tobytes(), *(a.tobytes() for level in levels for a in level)])


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes every text, ends it with ``end_id`` and writes the files; returns the list of files.

    One task writes one file, first under the name of its attempt and then renamed, so that
    an attempt that is lost or run twice leaves whole files only.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = store.partitions_for(spark, size, FILE_BYTES)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, between_spaces)
        doc_ids: list[int | None] = []
        lengths, ids = [], []
        for batch in batches:
            doc_ids += batch.column(0).to_pylist()
            for _, texts in array_slabs(batch.column(1)):
                found, counts, _ = own.encode(texts)
                lengths.append(counts + 1)
                ids.append(np.insert(found, np.cumsum(counts), end_id).astype(np.uint32))
        if not doc_ids:
            return
        task = TaskContext.get()
        name = f"part-{task.partitionId():08d}.dac"
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        attempt = f"{folder}/.{name}.{task.taskAttemptId()}"
        with system.open_output_stream(attempt) as out:
            out.write(_file(doc_ids, np.concatenate(lengths), total := np.concatenate(ids)))
        system.move(attempt, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({
            "file": [name], "file_no": pa.array([task.partitionId()], pa.int32()),
            "n_docs": [len(doc_ids)], "n_tokens": [len(total)],
        })

    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(encode, FILES)
    files.write.parquet(f"{path}/_files")
    return spark.read.schema(FILES).parquet(f"{path}/_files")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files at ``path``: its ids and where it starts among all tokens.

    Columns doc_id, start, n_tokens, ids (little-endian unsigned 32-bit).
    """
    files = spark.read.schema(FILES).parquet(f"{path}/_files")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{folder}/{name}") as source:
                    reader = Addressed(source)
                    doc_ids, starts = reader.documents()
                    begin = 0
                    while begin < len(doc_ids):
                        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + (1 << 20), "right")) - 1)
                        data = reader.tokens(int(starts[begin]), int(starts[end])).astype("<u4").tobytes()
                        bounds = (starts[begin : end + 1] - starts[begin]) * 4
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(doc_ids[begin:end], pa.int64()),
                            "start": base + starts[begin:end],
                            "n_tokens": np.diff(starts[begin : end + 1]),
                            "ids": pa.array([data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                        })
                        begin = end

    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return bases.repartition(store.partitions_for(spark, 0, 1), "file").mapInArrow(decode, TOKENS)
