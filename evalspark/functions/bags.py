"""Texts as bags of words, compared a batch of rows at a time.

SQL lowers a text and keeps what is a word character (``plain``); Arrow functions then find the
words in the bytes, number the distinct ones of a slab of rows and count equal numbers in one
sort.  Nothing is hashed without a check, and all sums are integers below 2**53, so results are
exact.  The functions are marked as not deterministic, so that Spark does not copy them into
filters; unused ones are still dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of text that are compared together, one row at least.
SLAB = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LONG = np.uint64(0xFF << 56)


def plain(text: str) -> str:
    """SQL: the text in lower case, with only letters and digits left of what is not ASCII."""
    cleared = rf"regexp_replace(lower({text}), r'[^\x00-\x7F\p{{L}}\p{{N}}]+', ' ')"
    return f"CASE WHEN octet_length({text}) = char_length({text}) THEN lower({text}) ELSE {cleared} END"


def cosines(texts: list[str]) -> Column:
    """Cosine of the word counts of each pair of several plain texts (SQL) of a row, as an array in
    the order (0, 1), (0, 2), ..., (1, 2), ...; 0 if either has no word."""
    sides = F.expr(f"array({', '.join(texts)})")
    return F.arrow_udf(_cosines, "array<double>").asNondeterministic()(sides)


def nearest(answers: list[str], texts: str, n_correct: str) -> Column:
    """For each plain answer (SQL) how near the nearest of the first ``n_correct`` plain texts of an
    array and of the others is: two numbers an answer, without the answer's own norm, which divides
    both alike."""
    said = F.expr(f"array({', '.join(answers)})")
    return F.arrow_udf(_nearest, "array<double>").asNondeterministic()(said, F.expr(texts), F.expr(n_correct))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _slabs(*columns: pa.Array) -> Iterator[list[pa.Array]]:
    """Ranges of rows of some arrays of texts with about SLAB bytes together."""
    ends = np.zeros(len(columns[0]), np.int64)
    for lists in columns:
        size = pc.fill_null(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False)
        ends += _sums(size)[np.cumsum(_lengths(lists))]
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + SLAB, "right")))
        yield [lists.slice(first, last - first) for lists in columns]
        first = last


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """The words of some texts as numbers, equal for equal words, how many each text has, and a
    bound of the numbers."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, buffer = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(int(offsets[-1] - offsets[0]) + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]

    word = _WORD[data[:-8]]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    filled = offsets[1:] > offsets[:-1]
    firsts, lasts = offsets[:-1][filled], offsets[1:][filled] - 1
    opens[firsts], closes[lasts] = word[firsts], word[lasts]
    starts = np.flatnonzero(opens)
    sizes = np.flatnonzero(closes) + 1 - starts

    # Up to eight bytes are their own key; longer words are numbered, under a byte no text has.
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    keys = eight[starts] & _KEEP[np.minimum(sizes, 8)]
    long = np.flatnonzero(sizes > 8)
    if len(long):
        at = _sums(sizes[long])
        parts = data[np.repeat(starts[long] - at[:-1], sizes[long]) + np.arange(at[-1])]
        parts = pa.Array.from_buffers(pa.large_binary(), len(long), [None, pa.py_buffer(at), pa.py_buffer(parts)])
        keys[long] = _LONG | pc.dictionary_encode(parts).indices.to_numpy().astype(np.uint64)
    coded = pc.dictionary_encode(pa.array(keys))
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers, np.diff(np.searchsorted(starts, offsets)), max(len(coded.dictionary), 1)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each stands there."""
    keys = np.sort(keys)
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[begins], np.diff(np.append(begins, len(keys)))


def _compared(texts: pa.Array, sides: int) -> np.ndarray:
    numbers, counts, distinct = _numbered(texts.flatten())
    rows = len(texts)
    row, side = np.divmod(np.arange(rows * sides), sides)
    base = np.repeat(row, counts) * distinct + numbers
    found, times = _counted(base * sides + np.repeat(side, counts))
    where, side = np.divmod(found, sides)
    row = where // distinct
    dots = np.zeros(rows * sides * sides)
    for step in range(sides):
        met = np.flatnonzero(where[step:] == where[: len(where) - step])
        cell = (row[met] * sides + side[met]) * sides + side[met + step]
        dots += np.bincount(cell, times[met] * times[met + step], len(dots))
    dots = dots.reshape(rows, sides, sides)
    first, second = np.triu_indices(sides, 1)
    squares = np.einsum("rss->rs", dots)
    norms = squares[:, first] * squares[:, second]
    return np.divide(dots[:, first, second], np.sqrt(norms), out=np.zeros(norms.shape), where=norms > 0)


def _cosines(texts: pa.Array) -> pa.Array:
    sides = int(_lengths(texts).max(initial=0))
    pairs = sides * (sides - 1) // 2
    found = [_compared(slab, sides).reshape(-1) for (slab,) in _slabs(texts)]
    offsets = np.arange(len(texts) + 1, dtype=np.int32) * pairs
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *found])))


def _near(answers: pa.Array, texts: pa.Array, n_correct: np.ndarray, asked: int) -> np.ndarray:
    """Numbers of every answer of a slab: the greatest dot / norm of each side, 0 without a text."""
    rows, per_row = len(answers), _lengths(texts)
    n_answers, n_texts = rows * asked, int(per_row.sum())
    numbers, counts, distinct = _numbered(pa.concat_arrays([answers.flatten(), texts.flatten()]))
    split = int(counts[:n_answers].sum())
    row_of_text = np.repeat(np.arange(rows), per_row)
    place = np.arange(n_texts) - _sums(per_row)[row_of_text]
    side = (place >= n_correct[row_of_text]).astype(np.int64)

    known, times = _counted(np.repeat(np.arange(n_answers), counts[:n_answers]) * distinct + numbers[:split])
    words, n = _counted(np.repeat(np.arange(n_texts), counts[n_answers:]) * distinct + numbers[split:])
    text, words = np.divmod(words, distinct)
    norms = np.sqrt(np.bincount(text, n * n, n_texts))
    near = np.zeros((n_answers, 2))
    for k in range(asked if len(known) else 0):
        answer_of_text = row_of_text * asked + k
        wanted = answer_of_text[text] * distinct + words
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        met = np.flatnonzero(known[at] == wanted)
        dots = np.bincount(text[met], n[met] * times[at[met]], n_texts)
        closeness = np.divide(dots, norms, out=np.zeros(n_texts), where=norms > 0)
        np.maximum.at(near, (answer_of_text, side), closeness)
    return near


def _nearest(answers: pa.Array, texts: pa.Array, n_correct: pa.Array) -> pa.Array:
    asked = int(_lengths(answers).max(initial=0))
    firsts = n_correct.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    found, done = [np.zeros(0)], 0
    for said, known in _slabs(answers, texts):
        found.append(_near(said, known, firsts[done : done + len(said)], asked).reshape(-1))
        done += len(said)
    offsets = (np.arange(len(answers) + 1) * 2 * asked).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
