import collections
import random

import helpers
import numpy as np
import pytest
import xxhash
from evalspark.llm import line_dedup, simhash, substring_dedup


def table(spark, edges):
    return helpers.documents(spark, extra=True) if edges else spark.read.parquet(f"{helpers.DATA}/documents.parquet")


def fingerprint(text, n=3):
    words = helpers.words(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).decode())
    shingles = [b" ".join(words[k : k + n]) for k in range(max(len(words) - n + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("edges", [True, False])
def test_simhash_equals_brute_force(spark, edges, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    docs = table(spark, edges)
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [(i, f) for i, f in rows if i is not None]
    for i, f in known:
        for j, g in known:
            if (f ^ g).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    by_print = {f: find(i) for i, f in known}
    expected = [(i, f"{f:016x}", by_print.get(f)) for i, f in rows]
    found = simhash.near_duplicates(docs, shingle=3, radius=2).collect()
    assert sorted([(r.doc_id, bytes(r.fingerprint).hex(), r.component_id) for r in found], key=str) == sorted(expected, key=str)


@pytest.mark.parametrize(("bits", "radius"), [(64, 0), (64, 2), (64, 7), (256, 44)])
def test_bit_slices_count_distances(bits, radius):
    dice = np.random.default_rng(5)
    base = dice.integers(0, 256, (40, bits // 8), np.uint8)
    prints = base[dice.integers(0, 40, 700)]
    flips = np.packbits(dice.random((700, bits)) < radius / bits * 0.6, axis=1)
    prints ^= flips
    begins = np.array([0, 1, 3, 64, 65, 200, 699])
    group = np.searchsorted(begins, np.arange(700), "right")
    found = {(int(i), int(j)) for a, b in simhash.near_pairs(prints, begins, radius) for i, j in zip(a, b, strict=True)}
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    close = (distance <= radius) & (group[:, None] == group) & (np.arange(700)[:, None] < np.arange(700))
    assert found == set(zip(*(x.tolist() for x in np.nonzero(close)), strict=True))


def test_components_of_long_chains(spark):
    order = random.Random(1).sample(range(300), 300)
    links = [tuple(sorted(p)) for p in zip(order[:200], order[1:200])] + [tuple(sorted(p)) for p in zip(order[200:], order[201:])]
    found = {r.id: r.component for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    for part in (order[:200], order[200:]):
        assert all(found.get(i, i) == min(part) for i in part)


def test_one_of_each_group_stays(spark):
    text = [f"w{k}" for k in range(200)]
    near = [*text[:60], "x", *text[61:]]
    rows = [(5, " ".join(text)), (5, " ".join(text)), (3, " ".join(near)), (9, "quite another text of a few words"), (None, " ".join(text)), (7, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, copy int")
    kept = simhash.keep_one(docs, shingle=5, radius=44, bits=256, tables=20)
    assert kept.columns == docs.columns
    assert helpers.plain(kept, "doc_id") == [(3,), (7,), (9,), (None,)]


@pytest.mark.parametrize(("edges", "size"), [(True, 8 << 20), (False, 8 << 20), (True, 300), (False, 100_000)])
def test_substrings_equal_brute_force(spark, edges, size, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", size)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2 * size)
    docs = table(spark, edges)
    rows = [(r.doc_id, helpers.words(r.text)) for r in docs.select("doc_id", "text").collect()]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    expected = []
    for i, w in rows:
        gone = {k + j for k in range(len(w) - 12 if i is not None else 0) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        expected.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    found = substring_dedup.remove_repeats(docs)
    assert helpers.plain(found, "doc_id", "n_words", "n_removed", "text") == sorted(expected, key=str)
    laid = substring_dedup.remove_repeats(docs, layout=True)
    assert [(a, b, n, b" ".join(helpers.words(t)).decode()) for a, b, n, t in helpers.plain(laid, "doc_id", "n_words", "n_removed", "text")] == sorted(expected, key=str)


def test_cover_has_every_distance():
    cover, period = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_lines_edges(spark):
    docs = helpers.documents(spark, extra=True)
    found = line_dedup.remove_blocks(docs)
    assert found.columns == [*docs.columns, "_n_lines", "_n_removed"]
    by = {(r.doc_id, r.text is None): r for r in found.collect()}
    assert len(by) == len({(r.doc_id, r.text is None) for r in docs.collect()}) and found.count() == docs.count()
    assert by[8, False].text == "Only here." and by[8, False]._n_removed == 2
    assert by[11, False].text == by[10, False].text == "" and by[1, False]._n_removed == 0
    assert by[3, True]._n_lines == 0 and by[None, False]._n_removed == 0 and by[2, False]._n_removed == 0
    assert line_dedup.remove_blocks(helpers.empty(spark, docs)).count() == 0


def test_common_lines_need_no_pairs(spark):
    rows = [(i, f"own {i}\nThe same for all.\nlast {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.aligned_blocks(docs).count() == 59
    texts = {r.doc_id: r.text for r in line_dedup.remove_blocks(docs).collect()}
    assert texts[0] == rows[0][1] and all(texts[i] == f"own {i}\nlast {i}" for i in range(1, 60))


def test_one_id_with_other_texts_and_many_lines(spark):
    many = "\n".join(f"line {k}" for k in range(50_000))
    rows = [(1, many), (2, "own\n" + many), (3, "a\nb\nc"), (3, "a\nb\nd"), (3, "a\nb\nd")]
    found = line_dedup.remove_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {i: sorted(r.n_removed for r in found if r.doc_id == i) for i in (1, 2, 3)}
    assert by[1] == [0] and by[2] == [50_000] and by[3] in ([0, 0, 2], [0, 2, 2])
    assert {r.text for r in found if r.doc_id == 2} == {"own"}


def every_pair(rows):
    """Places that go by the definition: each later document loses what aligns with any earlier one, over all lines both hold."""
    docs = {i: [x.strip() for x in t.split("\n") if x.strip()] for i, t in sorted(rows)}
    gone = {i: set() for i in docs}
    for b in docs:
        for a in docs:
            if a < b and (both := set(docs[a]) & set(docs[b])):
                one, two = ([(k, x) for k, x in enumerate(docs[i]) if x in both] for i in (a, b))
                gone[b] |= {two[j][0] for _, j in line_dedup.patience([x for _, x in one], [x for _, x in two])}
    return {i: "\n".join(x for k, x in enumerate(docs[i]) if k not in gone[i]) for i in docs}


def line_tables():
    dice = random.Random(11)
    separators = [(1, "***\nown")] + [(k, f"a{k}\n***\nb{k}") for k in range(2, 20)] + [(50, "x1\n***\nx2\n***\nx3"), (60, "x1\n***\nx2\n***\nx3")]
    crossed = [(1, "P\nQ")] + [(k, "Q\nP") for k in range(2, 30)] + [(40, "R\nQ\nP"), (41, "Q\nR\nS\nP"), (42, "S\nP\nP\nQ")]
    dealt = [(k, "\n".join(dice.choice("aaaabbbcdefgh") for _ in range(dice.randint(0, 9)))) for k in range(150)]
    return [separators, crossed, dealt]


@pytest.mark.parametrize("spread", [4096, 3])
@pytest.mark.parametrize("rows", [*line_tables(), None], ids=["separators", "crossed", "dealt", "table"])
def test_lines_equal_every_pair(spark, rows, spread, monkeypatch):
    monkeypatch.setattr(line_dedup, "SPREAD", spread)
    docs = spark.createDataFrame(rows, "doc_id long, text string") if rows else table(spark, False)
    rows = rows or [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.doc_id: "\n".join(x for x in map(str.strip, r.text.split("\n")) if x) for r in line_dedup.remove_blocks(docs).collect()}
    assert found == every_pair(rows)


@pytest.mark.parametrize(("one", "two", "aligned"), [("abcd", "abcd", 4), ("axbxc", "aybyc", 3), ("", "a", 0), ("aab", "ba", 1), ("xabcy", "zabcw", 3)])
def test_patience(one, two, aligned):
    pairs = line_dedup.patience(list(one), list(two))
    assert len(pairs) == aligned and all(one[i] == two[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_empty_tables(spark):
    none = helpers.empty(spark, helpers.documents(spark))
    assert simhash.near_duplicates(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0
