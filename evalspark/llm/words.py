"""Words of a column of texts as arrays: where they lie in the bytes, and hashes of runs of them.

A word is a run of bytes other than blank and U+0009 to U+000D.  Hashes are the same in every
process and at every place, so tasks can compare them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, null as empty, and where each text starts, with the end at the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # of the words, in data
    ends: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words at the end
    text_ends: np.ndarray  # of the texts, in data

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        begin = 0
        while begin < len(out):
            base = int(self.starts[begin])
            end = max(begin + 1, int(np.searchsorted(self.ends, base + SLAB, "right")))
            values, power, inverse = _VALUES[self.data[base : self.ends[end - 1]]], *_powers(int(self.ends[end - 1]) - base)
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * power, out=sums[1:])
            a, b = self.starts[begin:end] - base, self.ends[begin:end] - base
            out[begin:end] = mixed((sums[b] - sums[a]) * inverse[a])
            begin = end
        return out


_VALUES = mixed(np.arange(256, dtype=np.uint64), salt=7)
_BASE = 0x5851F42D4C957F2D
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, SLAB)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table))
        if n > SLAB:
            return tables[0], tables[1]
        _TABLES[:] = tables
    return _TABLES[0][:n], _TABLES[1][:n]


def words_of(texts: pa.Array) -> Words:
    data, offsets = text_bytes(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), offsets[1:])
    space = _SPACE[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets[1:])


def runs(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of every run of k hashes, also of those that cross texts: len(hashes) - k + 1 of them."""
    n = max(len(hashes) - k + 1, 0)
    own = mixed(hashes, salt + 11) if salt else hashes
    out = np.zeros(n, np.uint64)
    for j in reversed(range(k)):
        out *= np.uint64(_BASE + 2 * salt)
        out += own[j : j + n]
    return mixed(out, salt)
