import collections
import random
import unicodedata

import helpers
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from evalspark.llm import byte_bpe, packing, store, token_files, tokens
from evalspark.llm.tokens import Encoder, at_spaces, between_spaces
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORDS, BYTES, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def whole_table(spark):
    return spark.read.parquet(f"{helpers.DATA}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize(("path", "cut"), [(WORDS, between_spaces), (BYTES, at_spaces)])
def test_chunks_encode_like_whole_texts(path, cut):
    dice = random.Random(3)
    texts = ["".join(dice.choice(" \n\t  ab'sé１.,!<|endoftext|>\x1c\xa0　A9👍\0") for _ in range(dice.randint(0, 50))) for _ in range(4000)]
    encoder, tokenizer = Encoder(path, cut, offsets=True), Tokenizer.from_file(path)
    ids, counts, spans = encoder.encode(texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        known = tokenizer.encode(text, add_special_tokens=False)
        assert known.ids == ids[a:b].tolist()
        if cut is at_spaces and len(text) < 3:
            assert [tuple(s) for s in spans[a:b].tolist()] == known.offsets


@pytest.mark.parametrize(("path", "cut"), [(WORDS, between_spaces), (BYTES, at_spaces)])
def test_letters_that_become_letter_and_mark(path, cut):
    letters = [chr(c) for c in range(128, 0x20000) if chr(c).isalnum()]
    texts = ["पेड़,", "पेड़, पेड़", "Aİ.", *(f"ab{c}{m}" for c in letters for m in (",", "?!"))]
    encoder, tokenizer = Encoder(path, cut), Tokenizer.from_file(path)
    ids, counts, _ = encoder.encode(texts)
    ends = np.cumsum(counts)
    known = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, e, a, b in zip(texts, known, ends - counts, ends, strict=True) if e.ids != ids[a:b].tolist()] == []


@pytest.mark.parametrize(("path", "cut"), [(WORDS, between_spaces), (BYTES, at_spaces)])
def test_new_words_take_few_calls(path, cut, monkeypatch):
    """Beginning and ending a text costs the library more than a word does, so new words go to it many at a time."""
    given = []

    class Counting:
        def __init__(self, own):
            self.own = own

        def __getattr__(self, name):
            return getattr(self.own, name)

        def encode(self, text, **more):
            given.append(text)
            return self.own.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            given.extend(texts)
            return self.own.encode_batch_fast(texts, **more)

    tokenizer = Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "load", lambda source: Counting(tokenizer))
    dice = random.Random(5)
    words = ["".join(dice.choices("abcdefghißéñ", k=9)) + dice.choice(["", ",", "."]) for _ in range(5_000)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)]
    ids, counts, _ = Encoder(path, cut).encode(texts)
    known = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for own in known for i in own] and counts.tolist() == [len(own) for own in known]
    assert len(given) < 100


@pytest.mark.parametrize(("path", "cut"), [(WORDS, between_spaces), (BYTES, at_spaces)])
def test_joined_and_folded_words_keep_their_ids(path, cut):
    """Marks that compose or come first, letters that change their length, and names that are looked for before case is dropped."""
    dice = random.Random(4)
    composed = [unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0xFFFF) if unicodedata.decomposition(chr(c))[:1] not in ("", "<")]
    odd = ["\u0301", "\u0344", "T\u0308", "İ", "ẞ", "ΑΣ", "각", "Ω", "<|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|>", "'S", "I'LL", "\t", "\u2003", "\x1d", "\0", ",", "?!"]
    texts = ["".join(dice.choice(dice.choice((composed, odd, [" "], ["A", "b", "9"]))) for _ in range(dice.randint(0, 40))) for _ in range(3_000)]
    encoder, tokenizer = Encoder(path, cut), Tokenizer.from_file(path)
    ids, counts, _ = encoder.encode(pa.array([*texts, None]))
    ends = np.cumsum(counts)
    known = tokenizer.encode_batch([*texts, ""], add_special_tokens=False)
    assert [t for t, e, a, b in zip([*texts, ""], known, ends - counts, ends, strict=True) if e.ids != ids[a:b].tolist()] == []


def test_arrow_cuts_like_python():
    dice = random.Random(6)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = ["".join(dice.choice(["a", " ", " ", "é", "\0", dice.choice(blanks)][dice.randint(0, 1) :]) for _ in range(dice.randint(0, 9))) for _ in range(20_000)]
    for cut in (at_spaces, between_spaces):
        assert tokens._CUTS[cut][0](pa.array(texts, pa.large_string())).to_pylist() == [cut(t) for t in texts]


@pytest.mark.parametrize("edges", [True, False])
def test_token_files(spark, edges):
    docs = helpers.documents(spark, extra=True) if edges else whole_table(spark)
    path = store.fresh_path(spark, "tokens")
    token_files.write(docs, path, WORDS, end_id=2)
    tokenizer = Tokenizer.from_file(WORDS)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    expected, start = [], 0
    for row in rows:
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2]
        expected.append((row.doc_id, start, len(ids), helpers.crc(ids)))
        start += len(ids)
    found = token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc"))
    assert helpers.plain(found, "doc_id", "start", "n_tokens", "crc") == sorted(expected, key=str)


def test_random_access(tmp_path):
    ids = np.array([*range(0, 70_000, 7), 2**31, 0, 255, 256, 65_535, 65_536] * 2, np.uint32)
    (tmp_path / "x.dac").write_bytes(token_files._file([None, 5, 9], np.array([10, 0, len(ids) - 10]), ids))
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x.dac")) as source:
        reader = token_files.Addressed(source)
        assert reader.documents()[0] == [None, 5, 9] and reader.documents()[1].tolist() == [0, 10, 10, len(ids)]
        for i in [0, 1, 511, 512, 513, 10_000, 10_001, len(ids) - 1, *range(20, len(ids), 997)]:
            assert reader.token(i) == ids[i]
        for a, b in [(0, len(ids)), (5, 5), (510, 1030), (9_990, 10_008)]:
            assert (reader.tokens(a, b) == ids[a:b]).all()
        with pytest.raises(IndexError):
            reader.token(len(ids))


@pytest.mark.parametrize("edges", [True, False])
def test_byte_bpe_equals_tiktoken_and_comes_back(spark, edges):
    docs = helpers.documents(spark, extra=True) if edges else whole_table(spark)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    expected = [(r.doc_id, own.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()]
    found = byte_bpe.decode(encoded, RANKS).collect()
    assert sorted([(r.doc_id, r.ids, bytes(r.decoded)) for r in found], key=str) == sorted(expected, key=str)


def test_split_characters_and_offsets(spark):
    docs = spark.createDataFrame([(1, "a 👍🏽 b")], "doc_id long, text string")
    row = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, offsets=True).first()
    assert all(0 <= a < b <= 6 for a, b in zip(row.starts, row.ends, strict=True)) and len(row.ids) > 4
    parts = spark.createDataFrame([([i],) for i in row.ids] + [(None,)], "ids array<int>")
    pieces = byte_bpe.decode(parts, RANKS).collect()
    assert b"".join(bytes(p.decoded) for p in pieces[:-1]).decode() == "a 👍🏽 b" and pieces[-1].decoded is None


@pytest.mark.parametrize("edges", [True, False])
def test_packing(spark, edges):
    docs = helpers.documents(spark, extra=True) if edges else whole_table(spark)
    cut = store.written(packing.cut_documents(docs, BYTES, end_id=0, capacity=256))
    placed = packing.pack(cut, 256).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    expected = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        edge = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        expected += [(r.doc_id, k, a, b - a, helpers.crc(ids[a:b])) for k, (a, b) in enumerate(zip(edge, edge[1:]))]
    found = [(r.doc_id, r.piece, r.start, r.length, helpers.crc(np.frombuffer(r.ids, "<u4"))) for r in placed]
    assert sorted(found, key=str) == sorted(expected, key=str)
    sequences = collections.defaultdict(list)
    for r in placed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.02 * sum(r.length for r in placed) / 256 + 2
    if edges:
        whole = packing.assemble(packing.pack(cut, 256)).collect()
        assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in placed)


@pytest.mark.parametrize("lengths", [[], [5], [256] * 3, [90] * 10 + [80] * 10 + [1] * 7, list(range(1, 257)) * 4, [100] * 999 + [29] * 50])
def test_plan_holds_every_length(lengths):
    counts = collections.Counter(lengths)
    runs, held = packing.plan(dict(counts), 256), collections.Counter()
    for times, own in runs:
        assert 0 < sum(own) <= 256
        for length in own:
            held[length] += times
    assert +held == counts
    # Never more than first fit by single items.
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = next((i for i, r in enumerate(rooms) if r >= length), None)
        if fits is None:
            rooms.append(256 - length)
        else:
            rooms[fits] -= length
    assert sum(n for n, _ in runs) <= len(rooms)


def test_empty_tables(spark):
    none = helpers.empty(spark, helpers.documents(spark))
    path = store.fresh_path(spark, "tokens")
    token_files.write(none, path, WORDS, end_id=2)
    assert token_files.read(spark, path).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    assert packing.pack(store.written(packing.cut_documents(none, BYTES, 0, 2048)), 2048).count() == 0


def test_encoder_forgets_the_older_half(monkeypatch):
    """Ids and offsets stay those of whole texts while chunks are forgotten, some kept or all."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"word{i % 7} other{i}, and more{i % 50}. Ends  here!! \n now 99," for i in range(300)]
    for most in (5, 60, 400):
        monkeypatch.setattr(tokens, "MOST_CHUNKS", most)
        encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), tokens.at_spaces, offsets=True)
        plain = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), tokens.at_spaces)
        for k in range(0, len(texts), 9):
            some = texts[k : k + 9]
            whole = tokenizer.encode_batch(some, add_special_tokens=False)
            ids, counts, spans = encoder.encode(some)
            assert ids.tolist() == [i for e in whole for i in e.ids] == plain.encode(some)[0].tolist()
            assert counts.tolist() == [len(e.ids) for e in whole] and spans.tolist() == [list(o) for e in whole for o in e.offsets]


def test_spaces_that_need_care():
    for text in ("a  b", "a \n b", "a\x1c b", "a b ", "a　 　b", " a", "", " ", "a\0b c", "a\t  b c"):
        assert "".join(tokens.at_spaces(text)).replace("\0", "") == text.replace("\0", "")
        assert tokens.at_spaces(text) == (tokens._EDGE.split(text) if tokens._INNER_RUN.search(text) else text.replace(" ", "\0 ").split("\0"))
