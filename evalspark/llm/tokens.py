"""Encoding texts with the tokenizers library, once per distinct chunk instead of once per place.

A chunk is a part of a text at whose edges the tokenizer always cuts, so the ids of a text are
the ids of its chunks, one after the other.  Natural text repeats its chunks: Arrow cuts the
texts and finds the distinct chunks of a slab, the library is called for the few that a worker
has not met yet, and the rest are array look-ups.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core

from tokenizers import Tokenizer  # noqa: E402

# Chunks and ids that one worker remembers before it forgets those not met of late.
MOST_CHUNKS, MOST_IDS = 700_000, 6_000_000
# Bytes of text taken at a time, in general and by encoders, which look up each distinct chunk of a slab once.
SLAB_CHARS, ENCODED_CHARS = 1 << 20, 1 << 22
JOINED = 2_000  # new chunks given to the library as one text

# Characters that are neither letter, number, white space nor apostrophe, so that every pattern
# used here cuts between a letter or number and them.
MARKS = ".,;:!?*&%$#|"

_INNER_RUN = re.compile(r"\s (?:\s|\Z)|\0")
_INNER_PAIRS = ("\0", *(f"{c} " for c in " \t\n\v\f\r\x1c\x1d\x1e\x1f"))
_EDGE = re.compile(r"(?<=\S)(?= \S)")
# _INNER_RUN for Arrow, whose white space is ASCII only, and what is before the marks at the end.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ARROW_RUN = rf"{_BLANK} (?:{_BLANK}|\z)|\x00"
_STEM = rf"(?s)^.*[^{re.escape(MARKS)}]"


def at_spaces(text: str) -> list[str]:
    """Cuts before spaces, for byte-level patterns in which a space joins the word after it.

    A space inside a run of white space belongs to the run, so such texts are cut only at
    spaces that stand alone between two other characters.
    """
    # In ASCII text a look for each pair finds the same as the pattern, faster.
    doubtful = any(pair in text for pair in _INNER_PAIRS) if text.isascii() and text[-1:] != " " else True
    if doubtful and _INNER_RUN.search(text):
        return _EDGE.split(text)
    return text.replace(" ", "\0 ").split("\0")


def between_spaces(text: str) -> list[str]:
    """Cuts at blanks and line ends, for tokenizers that drop white space."""
    return text.replace("\n", " ").split(" ")


def _arrow_one_by_one(cut: Callable[[str], list[str]], texts: pa.Array) -> pa.Array:
    return pa.array(map(cut, texts.to_pylist()), pa.list_(pa.large_string()))


def _arrow_at_spaces(texts: pa.Array) -> pa.Array:
    doubtful = pc.match_substring_regex(texts, _ARROW_RUN)
    plain = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(doubtful)), " ", "\0 "), "\0")
    if len(plain) == len(texts):
        return plain
    others = _arrow_one_by_one(at_spaces, texts.filter(doubtful))
    return pa.concat_arrays([plain, others]).take(pa.array(np.argsort(np.argsort(doubtful, kind="stable"))))


def _arrow_between_spaces(texts: pa.Array) -> pa.Array:
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


# How Arrow cuts, what is between chunks that are joined to one text, and which chunks may be joined.
_CUTS = {
    at_spaces: (_arrow_at_spaces, "", re.compile(r" [^\s\0]+").fullmatch),
    between_spaces: (_arrow_between_spaces, " ", re.compile(r"[^ \n]*").fullmatch),
}


@functools.lru_cache(maxsize=4)
def load(source: str) -> Tokenizer:
    """A tokenizer from a file, or from its JSON itself; one per worker process."""
    return Tokenizer.from_str(source) if source.lstrip().startswith("{") else Tokenizer.from_file(source)


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class _Store:
    """An array that grows at its end, by doubling."""

    def __init__(self, shape: tuple[int, ...], kind: type):
        self.cells, self.size = np.zeros((1024, *shape), kind), 0

    def grow(self, size: int) -> None:
        """Zeros up to ``size``."""
        if size > len(self.cells):
            more = np.zeros((max(size - len(self.cells), len(self.cells)), *self.cells.shape[1:]), self.cells.dtype)
            self.cells = np.concatenate([self.cells, more])
        self.size = size

    def add(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        self.grow(end)
        self.cells[end - len(more) : end] = more


def _folds(normalizer: dict | None) -> bool:
    """Lower-cases, and does nothing else for which the case of an ASCII letter matters."""
    steps = (normalizer.get("normalizers") or [normalizer]) if normalizer else []
    blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    return {"type": "Lowercase"} in steps and all(s["type"] in ("Lowercase", "NFC", "NFD", "NFKC", "NFKD") or s == blanks for s in steps)


class Encoder:
    """Encodes lists of texts; remembers the ids (and offsets) of chunks within fixed bounds."""

    def __init__(self, source: str, cut: Callable[[str], list[str]], offsets: bool = False):
        self.tokenizer, self.offsets = load(source), offsets
        self.cut, self.between, self.joint = _CUTS.get(cut) or (functools.partial(_arrow_one_by_one, cut), "", None)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.folds = _folds(json.loads(self.tokenizer.to_str())["normalizer"])
        self._forget()

    def _forget(self) -> None:
        self.known, self.met = dict[str, int](), _Store((), bool)
        self.starts, self.lengths = _Store((), np.int64), _Store((), np.int64)
        self.ids, self.spans = _Store((), np.uint32), _Store((2,), np.int32)

    def _keep(self, numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray, spans: np.ndarray) -> None:
        self.starts.cells[numbers] = self.ids.size + np.cumsum(lengths) - lengths
        self.lengths.cells[numbers] = lengths
        self.ids.add(ids)
        if self.offsets:
            self.spans.add(spans)

    def _fit(self) -> None:
        """A place for every known chunk."""
        for store in (self.starts, self.lengths, self.met):
            store.grow(len(self.known))

    def _forget_older(self) -> None:
        """Keeps the chunks met since the last time, renumbered; all go if those are over half of a bound."""
        keys, kept = list(self.known), np.flatnonzero(self.met.cells[: self.met.size])
        starts, lengths = self.starts.cells[kept], self.lengths.cells[kept]
        if len(kept) > MOST_CHUNKS // 2 or lengths.sum() > MOST_IDS // 2:
            kept, starts, lengths = kept[:0], starts[:0], lengths[:0]
        where = flat_ranges(starts, lengths)
        ids, spans = self.ids.cells[where], self.spans.cells[where] if self.offsets else None
        self._forget()
        self.known.update(zip((keys[k] for k in kept), range(len(kept)), strict=True))
        self._fit()
        self._keep(np.arange(len(kept)), lengths, ids, spans)

    def _ends_in_letter(self, word: str) -> bool:
        """Also as the tokenizer's normalizer has it, which turns some letters into a letter and a mark."""
        if not word[-1:].isalnum() or word[-1].isascii() or self.tokenizer.normalizer is None:
            return word[-1:].isalnum()
        return self.tokenizer.normalizer.normalize_str(word)[-1:].isalnum()

    def _apart(self, chunks: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """A word and the marks after it are encoded apart, as both recur: which chunks are cut so, words, marks of these."""
        words = pc.utf8_rtrim(chunks, MARKS)
        ends = pc.utf8_slice_codeunits(words, -1, None).dictionary_encode()
        letters = np.array([self._ends_in_letter(c) for c in ends.dictionary.to_pylist()], bool)
        cut = letters[np.asarray(ends.indices)] & np.asarray(pc.not_equal(words, chunks))
        marks = pc.replace_substring_regex(chunks.filter(pa.array(cut)), _STEM, "")
        return cut, pc.if_else(pa.array(cut), words, chunks), marks

    def _folded(self, words: pa.Array) -> pa.Array:
        """ASCII words in lower case, where the tokenizer does not tell them apart."""
        if not self.folds:
            return words
        small = pc.ascii_lower(words)
        same = pc.string_is_ascii(words)
        for name in self.added:  # looked for before the normalizer
            same = pc.and_not(same, pc.match_substring(small, name, ignore_case=True))
        return pc.if_else(same, small, words)

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each of these distinct chunks, new ones encoded."""
        numbers = np.fromiter(map(self.known.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            numbers[missing] = np.arange(len(self.known), len(self.known) + len(missing))
            new = [chunks[i] for i in missing]
            self.known.update(zip(new, numbers[missing].tolist(), strict=True))
            self._fit()
            self._learn(new, numbers[missing])
        return numbers

    def _learn(self, new: list[str], numbers: np.ndarray) -> None:
        """Encodes new chunks, as many as can be in one text: the library takes long to begin and end a text."""
        alone = np.ones(len(new), bool)
        if self.joint is not None:
            alone[:] = [not self.joint(chunk) for chunk in new]
        together = np.flatnonzero(~alone)
        for begin in range(0, len(together), JOINED):
            some = together[begin : begin + JOINED]
            self._learn_joined([new[i] for i in some], numbers[some])
        alone = np.flatnonzero(alone)
        if not len(alone):
            return
        # Offsets take the library longer, so it is asked for them only where they are read.
        encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        found = encode([new[i] for i in alone], add_special_tokens=False)
        ids = [e.ids for e in found]
        spans = [o for e in found for o in e.offsets] if self.offsets else []
        self._keep(
            numbers[alone],
            np.fromiter(map(len, ids), np.int64, len(ids)),
            np.fromiter(itertools.chain.from_iterable(ids), np.uint32),
            np.array(spans, np.int32).reshape(-1, 2),
        )

    def _learn_joined(self, chunks: list[str], numbers: np.ndarray) -> None:
        """Encodes chunks as one text, which would be cut into them again; offsets tell whose an id is."""
        found = self.tokenizer.encode(self.between.join(chunks), add_special_tokens=False)
        begins = np.fromiter(map(len, chunks), np.int64, len(chunks)) + len(self.between)
        begins = np.cumsum(begins) - begins
        spans = np.array(found.offsets, np.int64).reshape(-1, 2)
        owner = np.searchsorted(begins, spans[:, 0], "right") - 1
        spans -= begins[owner][:, None]
        self._keep(numbers, np.bincount(owner, minlength=len(chunks)), np.array(found.ids, np.uint32), spans)

    def _encode_distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of chunks one after the other, the number of each chunk's, and (with offsets) each id's characters."""
        cut, words, marks = self._apart(chunks)
        pieces = pa.concat_arrays([self._folded(words), marks]).dictionary_encode()
        numbers = self._numbers(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        self.met.cells[numbers] = True
        at = numbers[np.asarray(pieces.indices)]
        parts = np.zeros((len(chunks), 2), np.int64)
        parts[:, 0], parts[cut, 1] = at[: len(chunks)], at[len(chunks) :]
        lengths = self.lengths.cells[parts]
        lengths[~cut, 1] = 0
        where = flat_ranges(self.starts.cells[parts].ravel(), lengths.ravel())
        spans = np.zeros((0, 2), np.int32)
        if self.offsets:
            shift = np.zeros_like(lengths, np.int32)
            shift[:, 1] = pc.utf8_length(words)
            spans = self.spans.cells[where] + np.repeat(shift.ravel(), lengths.ravel())[:, None]
        return self.ids.cells[where], lengths.sum(axis=1), spans

    def encode(self, texts: Sequence[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number of ids of each text (null is empty), and (with offsets) each id's characters."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string()), "")
        lists = self.cut(texts)
        counts, chunks = np.asarray(pc.list_value_length(lists), np.int64), lists.flatten()
        distinct = chunks.dictionary_encode()
        ids, lengths, spans = self._encode_distinct(distinct.dictionary)
        starts, at = np.cumsum(lengths) - lengths, np.asarray(distinct.indices)
        lengths = lengths[at]
        where = flat_ranges(starts[at], lengths)
        chunk_ends = np.concatenate([[0], np.cumsum(lengths)])
        text_ends = chunk_ends[np.cumsum(counts, dtype=np.int64)]
        if self.offsets:
            chars = np.asarray(pc.utf8_length(chunks), np.int64)
            begin = np.cumsum(chars) - chars
            first = np.repeat(np.cumsum(counts) - counts, counts)
            begin = begin - begin[first] if len(begin) else begin
            spans = spans[where] + np.repeat(begin, lengths)[:, None].astype(np.int32)
        if len(self.known) > MOST_CHUNKS or self.ids.size > MOST_IDS:
            self._forget_older()
        return ids[where], np.diff(text_ends, prepend=0), spans


@functools.lru_cache(maxsize=2)
def encoder(source: str, cut: Callable[[str], list[str]], offsets: bool = False) -> Encoder:
    """The encoder of this worker process, so that its tasks share what it has learned."""
    return Encoder(source, cut, offsets)


def array_slabs(texts: pa.Array, size: int = ENCODED_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """The texts of a batch, about ``size`` bytes at a time: (first row, texts)."""
    if not len(texts):
        return
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    begin = 0
    while begin < len(texts):
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + size, "right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end


def slabs(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch, null as empty, some at a time: (first row, texts)."""
    for begin, some in array_slabs(texts, SLAB_CHARS):
        yield begin, [t or "" for t in some.to_pylist()]
