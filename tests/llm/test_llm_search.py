import math

import numpy as np
import pytest
from evalspark.llm import top_products, vantage
from evalspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
NAN, INF = math.nan, math.inf
EDGES = [
    (0, [1.0, 0.0]), (50, [0.5, 0.5]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [NAN, 1.0]),
    (6, [INF, 1.0]), (7, [0.0, 0.0]), (8, [-1.0, -2.0]), (9, []), (10, [1.0]), (None, [1.0, 1.0]), (200, None), (11, [0.5, 0.5]),
]


def edges(spark):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in EDGES], "vec_id long, embedding array<double>, block int, band int, label int")


def loaded(spark):
    rows = sorted(spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect())
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


def lists(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def brute(ids, score, usable, every, k):
    out = {}
    for i in np.flatnonzero((ids % every == 0) & usable):
        own = score(i)
        order = [j for j in np.lexsort((ids, own)) if j != i and usable[j]][:k]
        out[int(ids[i])] = [(int(ids[j]), own[j]) for j in order]
    return out


@pytest.mark.parametrize("shard", [1024, 60])
def test_factor_one_is_exact(spark, shard, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD", shard)
    ids, x = loaded(spark)
    found = lists(QUERIES["op4_vantage_points"](spark, DATA))
    expected = brute(ids, lambda i: np.sqrt(((x - x[i]) ** 2).sum(axis=1)), np.ones(len(ids), bool), 100, 10)
    assert {q: [v for v, _ in r] for q, r in found.items()} == {q: [v for v, _ in r] for q, r in expected.items()}
    assert all(abs(a - b) < 1e-12 for q in found for (_, a), (_, b) in zip(found[q], expected[q], strict=True))


def test_recall_falls_with_the_factor(spark):
    ids, x = loaded(spark)
    tree = vantage.build(ids, x)
    truth = np.argsort(np.sqrt(((x[:50, None] - x) ** 2).sum(axis=2)) + 10 * np.eye(50, len(x)), axis=1)[:, :10]
    recall = []
    for factor in (1, 4, 30):
        found, _ = vantage.nearest(tree, ids[:50], x[:50], np.full(50, np.inf), 10, factor)
        recall.append(np.mean([len({*ids[t]} & {*f}) / 10 for t, f in zip(truth, found, strict=True)]))
    assert recall[0] == 1 and recall[1] >= 0.9 and recall[2] < recall[1]


def test_nearest_edges(spark):
    rows = edges(spark)
    found = lists(vantage.search(rows, rows.where("vec_id % 50 = 0"), k=3, factor=1.0))
    assert [v for v, _ in found[0]] == [1, 2, 11] and found[0][0][1] == 0  # 50 and 11 are as far: the smaller id
    assert sorted(found) == [0, 50, 100] and [v for v, _ in found[50]][0] == 11


def test_nearest_edges_ties():
    ids = np.array([4, 2, 9, 7])
    found, _ = vantage.nearest(vantage.build(ids, np.ones((4, 2))), np.array([9]), np.ones((1, 2)), np.array([np.inf]), 2, 1.0)
    assert found.tolist() == [[2, 4]]


@pytest.mark.parametrize("block", [1024, 40])
def test_products_are_exact(spark, block, monkeypatch):
    monkeypatch.setattr(top_products, "BLOCK", block)
    ids, x = loaded(spark)
    whole = np.floor(256 * x).astype(np.int64)
    expected = brute(ids, lambda i: -(whole @ whole[i]), np.ones(len(ids), bool), 50, 5)
    found = lists(QUERIES["op5_exact_top_products"](spark, DATA))
    assert found == {q: [(v, -s) for v, s in r] for q, r in expected.items()}


def test_product_edges(spark):
    rows = edges(spark)
    found = lists(top_products.search(rows, rows.where("vec_id % 50 = 0"), k=3, scale=256))
    assert found[0] == [(1, 65536), (2, 65536), (11, 32768)]
    assert found[100] == [(11, 32768), (50, 32768), (0, 0)] and sorted(found) == [0, 50, 100]
    few = rows.where("vec_id IN (0, 8)")
    assert lists(top_products.search(few, few, k=5, scale=256)) == {0: [(8, -65536)], 8: [(0, -65536)]}


@pytest.mark.parametrize("k", [2, 5])
def test_products_with_negative_ids(spark, k):
    vectors = {-7: [1.0, 0.0], -1: [0.5, 0.5], -(2**63): [0.0, 1.0], 0: [0.25, 0.0], 4: [-1.0, 0.0]}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    found = lists(top_products.search(rows, rows.where("vec_id IN (0, -7)"), k=k, scale=256))
    expected = {0: [(-7, 16384), (-1, 8192), (-(2**63), 0), (4, -16384)], -7: [(-1, 32768), (0, 16384), (-(2**63), 0), (4, -65536)]}
    assert found == {q: r[:k] for q, r in expected.items()}


def test_large_components_stay_exact():
    rows = np.array([[2.0**40, 3.0], [2.0**40, 1.0], [2.0**62, 2.0**62]])
    assert top_products.exact(rows[:1], rows).tolist() == [[2**80 and 2**63 - 1, 2**63 - 1, 2**63 - 1]]
    small = np.array([[2.0**30, 3.0], [2.0**30, 1.0]])
    assert top_products.exact(small, small).tolist() == [[2**60 + 9, 2**60 + 3], [2**60 + 3, 2**60 + 1]]


def test_empty_tables(spark):
    none = edges(spark).where("vec_id < -5")
    assert vantage.search(none, none, 3, 1.0).count() == 0 and top_products.search(none, none, 3, 256).count() == 0
