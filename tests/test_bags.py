"""Words counted a batch at a time: against plain counting, and only once where a sample is drawn."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalspark.functions import bags
from evalspark.functions.similarity import TextSimilarity, text_cosine
from evalspark.operators import references
from evalspark.plans import registry, views

TEXTS = [
    None, "", " -- ", "a", "A a b", "b,A\na", "Ünïcode über ÜBER x", "İstanbul ΟΔΟΣ οδος", "一二 三 一二", "eightlet eightlett",
    "incomprehensibly long-winded incomprehensibly", "x—y x² ١٢ café café", "the " * 300 + "end", "nul\x00l nul l",
]
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("slab", [1, 1 << 20])
def test_cosines_equal_those_of_one_row(spark, monkeypatch, slab):
    monkeypatch.setattr(bags, "SLAB", slab)
    rows = [(x, y, z) for x in TEXTS for y in TEXTS for z in (None, "a x", TEXTS[-3])]
    frame = spark.createDataFrame(rows, "x string, y string, z string")
    similar = TextSimilarity()
    pairs = [("x", "y"), ("x", "z"), ("y", "z")]
    expected = frame.selectExpr(*(text_cosine(*p) for p in pairs)).collect()
    sides = frame.select(F.array(*(F.expr(bags.plain(c)) for c in "xyz")).alias("t")).toArrow().column(0).combine_chunks()
    found = bags._cosines(sides).to_pylist()
    assert found == [list(e) for e in expected]
    added = similar.compared(frame, "xyz")
    assert added.columns == [*"xyz", *(similar(*p) for p in pairs)]
    assert [tuple(r)[3:] for r in added.collect()] == [tuple(e) for e in expected]


@pytest.mark.parametrize("slab", [1, 1 << 20])
def test_nearest_equals_counting(spark, monkeypatch, slab):
    monkeypatch.setattr(bags, "SLAB", slab)
    sets = [None, ["a"], ["a b", "b", "", "x x a"], ["incomprehensibly", None, "über a a", "a", "the end"], ["a"] * 5]
    rows = [(a, s, n) for a in ("a b a", "Über incomprehensibly", None, "") for s in sets for n in (0, 1, 2)]
    frame = spark.createDataFrame(rows, "a string, texts array<string>, n_correct int")
    frame = frame.withColumn("b", F.lit("the x"))
    near = bags.nearest(["a", "b"], f"transform(texts, t -> {bags.plain('t')})", "n_correct")
    plain = frame.withColumn("a", F.expr(bags.plain("a")))

    def best(answer, texts):
        said = Counter((answer or "").lower().split())
        counted = [Counter((t or "").lower().split()) for t in texts]
        return max((sum(n * said[w] for w, n in c.items()) / math.sqrt(sum(n * n for n in c.values())) for c in counted if c), default=0.0)

    for row in plain.withColumn("near", near).collect():
        texts, n = row["texts"] or [], row["n_correct"]
        wanted = [best(x, side) for x in (row["a"], "the x") for side in (texts[:n], texts[n:])]
        assert row["near"] == pytest.approx(wanted, abs=1e-12)


def test_no_words_are_sorted_row_by_row(spark):
    for frame in (views.results(spark, SF), references.reference_labels(views.results(spark, SF), views.references(spark, SF))):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "sort_array" not in plan and "map_zip_with" not in plan


def test_the_audit_labels_all_rows_once(spark):
    plan = registry.QUERIES["audit_sample"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_nearest" not in plan
