"""Byte-level BPE from a rank file: encoding with offsets, and decoding back to bytes.

The vocabulary is a list of byte strings with ranks.  The tokenizers library works on
characters, so every byte stands as one printable character (``byte_characters``), and the
merges are those by which each byte string of the file comes from two of lower rank.

A null text counts as empty, an empty text has no ids, and no string is a special token.
Other columns are left out of the results, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import store
from evalspark.llm.tokens import SLAB_CHARS, array_slabs, at_spaces, encoder, flat_ranges


@functools.cache
def byte_characters() -> list[str]:
    """A printable character for each byte: Latin-1's own where it is visible, else from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(visible))
    shifted = {b: chr(256 + n) for n, b in enumerate(others)}
    return [shifted.get(b, chr(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The last merge that makes ``token``: its bytes merged by lower ranks until two parts are left."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        pairs = [ranks.get(a + b, len(ranks)) for a, b in zip(parts, parts[1:])]
        i = min(range(len(pairs)), key=pairs.__getitem__)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


@functools.lru_cache(maxsize=4)
def tokenizer_json(path: str, pattern: str) -> str:
    """The rank file as a tokenizer of the tokenizers library, in its JSON form."""
    ranks = read_ranks(path)
    shown = str.maketrans(dict(enumerate(byte_characters())))

    def show(token: bytes) -> str:
        return token.decode("latin-1").translate(shown)

    ordered = sorted(ranks, key=ranks.__getitem__)
    merges = [[*map(show, _halves(t, ranks))] for t in ordered if len(t) > 1]
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        ]},
        "post_processor": None, "decoder": None,
        "model": {
            "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
            "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
            "vocab": {show(t): ranks[t] for t in ordered}, "merges": merges,
        },
    })


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int32)))


def encode(df: DataFrame, path: str, pattern: str, offsets: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the ids of each text; with ``offsets`` also each id's first and last+1 character.

    Where a character is split between ids, they all have that character's offsets.
    """
    source = df.sparkSession.sparkContext.broadcast(tokenizer_json(path, pattern))  # of the file's size
    kinds = "doc_id long, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(source.value, at_spaces, offsets)
        for batch in batches:
            for first, texts in array_slabs(batch.column(1), SLAB_CHARS):  # decoding runs beside it
                ids, counts, spans = own.encode(texts)
                columns = [batch.column(0).slice(first, len(texts)), _lists(ids, counts)]
                if offsets:
                    columns += [_lists(spans[:, 0], counts), _lists(spans[:, 1], counts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "starts", "ends"][: len(columns)])

    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, kinds)


def decode(df: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its ids stand for, as binary; a null list gives null.

    Bytes are joined before anything reads them as UTF-8, so a character that several ids
    share comes back whole.
    """
    shown = {c: b for b, c in enumerate(byte_characters())}
    ranks = read_ranks(path)
    forward = str.maketrans(dict(enumerate(byte_characters())))
    # The vocabulary as the library shows it, then back through the table: id -> bytes.
    words = {rank: token.decode("latin-1").translate(forward) for token, rank in ranks.items()}
    table = [bytes(shown[c] for c in words.get(i, "")) for i in range(max(words, default=-1) + 1)]
    shared = df.sparkSession.sparkContext.broadcast(table)  # of the file's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        pool = np.frombuffer(b"".join(table), np.uint8)
        lengths = np.fromiter(map(len, table), np.int64, len(table))
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                lists = part.column(part.schema.get_field_index(ids))
                at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                size = lengths[at]
                data = pool[flat_ranges(starts[at], size)].tobytes()
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
                cells = [data[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.binary())], [*part.schema.names, name])

    return df.mapInArrow(run, store.with_columns(df, f"`{name}` binary"))
