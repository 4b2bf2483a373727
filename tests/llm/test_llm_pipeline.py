import collections
import random

import corpus_pipeline as pipeline
import helpers
import pytest
from evalspark.llm import simhash, store
from test_llm_dedup import fingerprint


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{helpers.DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = store.written(stage(spark, docs, helpers.DATA), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    assert docs.where("n_chars <> length(text)").count() == 0
    placed = pipeline.STAGES[-1][1](spark, docs, helpers.DATA).collect()
    assert {r.doc_id for r in placed} == {r.doc_id for r in docs.collect()}
    lengths = collections.Counter()
    for r in placed:
        lengths[r.sequence_id] += r.length
    assert max(lengths.values()) <= 2048
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in pipeline.run(spark, helpers.DATA).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in placed)


def shingles(text):
    w = helpers.words(text.lower())
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else {()}


def jaccard(one, two):
    return len(one & two) / len(one | two)


def isolated_pairs():
    """Pairs of texts that share no shingle with other pairs, with similarities around 0.8."""
    dice, out = random.Random(8), []
    for n in range(160):
        size = dice.choice([4, 5, 9, 40, 120, 400])
        text = [f"p{n}w{k}" for k in range(size + 4)]
        share = dice.uniform(0.7, 0.9)
        shared = round(2 * share / (1 + share) * size) if size > 9 else size - dice.randint(0, 1)
        out += [" ".join(text), " ".join(text[: shared + 4] + [f"p{n}x{k}" for k in range(size - shared)])]
    return out


def equal_fingerprints():
    """A shingle that makes most of each text, which says something else besides."""
    return [". " * 300 + " ".join(f"q{n}w{k}" for k in range(100)) for n in range(6)]


@pytest.mark.parametrize(("texts", "tile"), [(isolated_pairs(), 1 << 18), (isolated_pairs(), 100), (equal_fingerprints(), 1 << 18)], ids=["pairs", "tiles", "prints"])
def test_near_duplicates_equal_brute_force(spark, texts, tile, monkeypatch):
    monkeypatch.setattr(simhash, "SET_TILE", tile)
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if sets[a] & sets[b] and jaccard(sets[a], sets[b]) >= 0.8:
                root = [root[a] if r == root[b] else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = simhash.keep_one(docs, shingle=5, radius=80, bits=256, tables=20, similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_near_duplicate_stage_keeps_one_of_each_chain(spark):
    docs = spark.read.parquet(f"{helpers.DATA}/documents.parquet")
    prints = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    root = {i: i for i in prints}
    for j in sorted(prints):
        for i in (i for i in sorted(prints) if i < j and (prints[i] ^ prints[j]).bit_count() <= 2):
            one, two = sorted((root[i], root[j]))
            root = {k: one if r == two else r for k, r in root.items()}
    assert len(set(root.values())) < len(root)
    kept = dict(pipeline.STAGES)["simhash_near_dedup"](spark, docs, helpers.DATA)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_edges_and_clashing_columns(spark, name):
    docs = helpers.documents(spark, extra=True)
    stage = dict(pipeline.STAGES)[name]
    found = stage(spark, docs, helpers.DATA)
    found.collect()
    if name != pipeline.STAGES[-1][0]:
        assert found.columns == docs.columns
    assert stage(spark, helpers.empty(spark, docs), helpers.DATA).count() == 0
