"""The registered queries over whole tables, against brute force."""

import collections
import hashlib

import helpers
import public_tokenizers
import pyarrow.parquet as pq
import tiktoken
from evalspark.llm import byte_bpe
from evalspark.llm.queries import ORACLE, QUERIES
from test_llm_dedup import every_pair, fingerprint
from tokenizers import Tokenizer

DOCS = {r["doc_id"]: r["text"] for r in pq.read_table(f"{helpers.DATA}/documents.parquet").to_pylist()}


def result(spark, number):
    (name,) = (n for n in QUERIES if n.startswith(f"op{number}_"))
    return QUERIES[name](spark, helpers.DATA).collect()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_op1(spark):
    prints = {i: fingerprint(t) for i, t in DOCS.items()}
    component = {}
    for i in sorted(prints):  # flood from the smallest id
        todo = [] if i in component else [i]
        while todo:
            j = todo.pop()
            component[j] = i
            todo += [k for k in prints if k not in component and k not in todo and (prints[j] ^ prints[k]).bit_count() <= 2]
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in result(spark, 1)} == {(i, f"{f:016x}", component[i]) for i, f in prints.items()}


def test_op2(spark):
    tokenizer, start, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, set()
    for i in sorted(DOCS):
        ids = [*tokenizer.encode(DOCS[i], add_special_tokens=False).ids, 2]
        expected.add((i, start, len(ids), helpers.crc(ids)))
        start += len(ids)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in result(spark, 2)} == expected


def test_op3(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = set()
    for i, text in DOCS.items():
        ids = own.encode_ordinary(text)
        shown = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        expected.add((i, len(ids), shown, hashlib.sha256(text.encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in result(spark, 3)} == expected


def test_op6(spark):
    tokenizer, expected, sequences = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set(), collections.defaultdict(list)
    for i, text in DOCS.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        expected |= {(i, k, a, b - a, helpers.crc(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))}
    rows = result(spark, 6)
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        ends = [a + n for a, n in sorted(members)]
        assert [a for a, _ in sorted(members)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) * 1.01 + 1


def test_op10(spark):
    kept = every_pair(DOCS.items())
    lines = {i: [x for x in map(str.strip, t.split("\n")) if x] for i, t in DOCS.items()}
    expected = {i: (len(own), len(own) - len(kept[i].split("\n") if kept[i] else [])) for i, own in lines.items()}
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in result(spark, 10)} == expected
    assert sum(n for _, n in expected.values()) > 50
