import zlib

import helpers
import numpy as np
import pytest
from evalspark.llm import language, quality
from evalspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = QUERIES["op7_language_id"](spark, DATA).collect()
    assert len(found) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in found)
    judged = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in judged]) > 0.98


def test_language_edges(spark):
    docs = helpers.documents(spark, extra=True)
    model = language.fit(docs)
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (3, 4, 5)) and found[1].lang_pred == "en"
    strange = spark.createDataFrame([(1, "ψψψωωω ξξξ"), (2, "123 !!")], "doc_id long, text string")
    far = {r.doc_id: r for r in language.identify(strange, model).collect()}
    assert far[1].rejected and far[2].lang_pred == "und"
    none = helpers.empty(spark, docs)
    assert language.fit(none) is None and language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    found = QUERIES["op8_quality_classifier"](spark, DATA).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    judged = [(labels[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in judged]) > 0.93


def test_quality_never_sees_held_out_labels(spark):
    docs = spark.read.parquet(f"{helpers.DATA}/documents.parquet")
    labels = spark.read.parquet(f"{helpers.DATA}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id AS string)) % 4 = 2, 1 - quality, quality) AS quality", "toxic")
    one, two = (helpers.plain(quality.classify(docs, x), "doc_id", "score") for x in (labels, flipped))
    assert [i for i, _ in one] == [i for i, _ in two] and np.allclose([s for _, s in one], [s for _, s in two])


def test_quality_edges(spark):
    docs = helpers.documents(spark, extra=True)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {1.0}
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(1, None), (None, 0)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == docs.count()
    assert quality.classify(helpers.empty(spark, docs), labels).count() == 0
    assert quality.keep_good(docs, none).columns == docs.columns and quality.keep_good(docs, none).count() == docs.count()


@pytest.mark.parametrize(("good", "total", "shares"), [
    ([0, 1, 0, 2], [1, 1, 1, 2], [0, 0.5, 0.5, 1]), ([3, 0], [3, 3], [0.5, 0.5]), ([0, 0, 2], [1, 0, 2], [0, 0.5, 1]),
])
def test_isotonic(good, total, shares):
    assert quality.isotonic(np.array(good, float), np.array(total, float)).tolist() == shares
