"""Edge rows of the text clean-up and the verdict parser, one case each."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.functions.booleans import tri_state, two_state
from evalspark.functions.similarity import text_cosine, vector_cosine
from evalspark.functions.text import clean_output, is_attempted, is_failed, is_truncated, shorten
from evalspark.operators import pipeline, requests, triage


def values(spark, kind, inputs, expression):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    rows = frame.selectExpr("i", f"{expression} AS y").orderBy("i").collect()
    return [row["y"] for row in rows]


def test_clean_output(spark):
    cases = {
        "<think>a</think> yes ": "yes",
        "<think>a\nb</think>\n one <think>c</think>two": "one two",
        "cut off</think> answer </think> more": "answer </think> more",
        "<think>never closed": "<think>never closed",
        "\t\n plain\x0b 　": "plain",
        "<think>a</think>": "",
        "<think>x<think>y</think>z</think>w": "w",
    }
    assert values(spark, "string", cases, clean_output("x")) == list(cases.values())
    assert values(spark, "string", ["<think>a", "b <think>"], is_truncated("x")) == [True, False]


def test_failed_and_attempted(spark):
    inputs = ["ok", "", " \n", "ERROR: x", None, "nan", " NaN ", "nano", " ERROR: y"]
    assert values(spark, "string", inputs, is_failed("x")) == [
        False, True, True, True, True, False, False, False, False,
    ]
    assert values(spark, "string", inputs, is_attempted("x")) == [
        True, False, False, True, False, False, False, True, True,
    ]


def test_booleans(spark):
    inputs = ["True", " false ", "", "nan", None, "yes"]
    assert values(spark, "string", inputs, tri_state("x")) == [True, False, None, None, None, None]
    assert values(spark, "string", inputs, two_state("x")) == [
        True, False, False, False, False, False,
    ]


def test_shorten(spark):
    assert values(spark, "string", ["a\nb", "abcdef", None], shorten("x", 4)) == [
        "a b", "abcd...", "nan",
    ]


def cosine(x, y):
    def bag(text):
        return Counter("".join(c if c.isalnum() else " " for c in text.lower()).split())

    a, b = bag(x), bag(y)
    norm = sum(n * n for n in a.values()) * sum(n * n for n in b.values())
    return sum(n * b[w] for w, n in a.items()) / math.sqrt(norm) if norm else 0.0


words = st.lists(st.sampled_from(["a", "B", "b", "été", "the", "The.", "x1", "--"]), max_size=12)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=20, max_size=40))
def test_text_cosine_equals_counting(spark, pairs):
    texts = [(" ".join(x), " ".join(y)) for x, y in pairs]
    frame = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, x string, y string")
    rows = frame.selectExpr(
        "i", f"{text_cosine('x', 'y')} AS xy", f"{text_cosine('y', 'x')} AS yx"
    ).orderBy("i").collect()
    for row, (x, y) in zip(rows, texts, strict=True):
        assert row["xy"] == row["yx"] == pytest.approx(cosine(x, y), abs=1e-12)
        assert 0 <= row["xy"] <= 1


def test_cosine_of_nothing(spark):
    frame = spark.createDataFrame([(None, "a")], "x string, y string")
    assert frame.selectExpr(f"{text_cosine('x', 'y')} AS c").first()["c"] == 0.0
    assert frame.selectExpr(
        f"{vector_cosine('array(1.0, 2.0)', 'array(2.0, 4.0)')} AS c",
        f"{vector_cosine('array(0.0, 0.0)', 'array(2.0, 4.0)')} AS z",
        f"{vector_cosine('array(1.0, 0.0)', 'array(-1.0, 0.0)')} AS o",
    ).first() == (1.0, 0.0, -1.0)


GOOD = '"answer_b_correct": true, "selection_status": "a_correct", "selected_answer": "a"'


def parse(spark, replies, truthy=False):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "row_id long, verdict string")
    return pipeline.parse_verdicts(frame, truthy).orderBy("row_id").collect()


def flags(spark, fields, truthy=False):
    rows = parse(spark, ["{" + f'"answer_a_correct": {f}, ' + GOOD + "}" for f in fields], truthy)
    return [row["said_a"] for row in rows]


def test_verdict_values(spark):
    fields = ["true", "false", '"false"', '" TRUE "', '"maybe"', "0", "2.5", "null", "[1]", "[]", "{}"]
    assert flags(spark, fields) == [
        True, False, False, True, None, False, True, False, None, None, None,
    ]
    assert flags(spark, fields, truthy=True) == [
        True, False, True, True, True, False, True, False, True, False, False,
    ]


def test_verdict_text(spark):
    whole = '{"answer_a_correct": false, ' + GOOD + "}"
    cases = {
        f"Sure! {whole} Done.": True,
        f"<think>{{ bad</think>{whole}": True,
        whole[:-1]: False,
        f"{whole} {whole}": False,
        f"{whole}],[{whole}": False,
        f'{whole}, "x": {whole}': False,
        "no json": False,
        "{'answer_a_correct': true}": False,
        '{"answer_a_correct": true}': False,
        whole.replace('"a_correct"', "null"): False,
    }
    rows = parse(spark, cases)
    assert [row["parsed"] for row in rows] == list(cases.values())
    assert (rows[0]["said_status"], rows[0]["said_selected"], rows[0]["said_reason"]) == (
        "A_CORRECT", "A", "",
    )
    assert not rows[0]["said_base"]


def evaluate(spark, **fields):
    row = {
        "row_id": 1, "question": "q", "ground_truth": "blue sky", "reply_a": "blue sky",
        "reply_b": "green sea", "reply_base": None, "verdict": "unreadable",
    } | fields
    schema = "row_id long, " + ", ".join(f"{c} string" for c in row if c != "row_id")
    frame = spark.createDataFrame([tuple(row.values())], schema)
    return pipeline.evaluate(frame).first()


def test_fallback_grades_by_similarity(spark):
    row = evaluate(spark)
    assert (row["a_correct"], row["b_correct"], row["status"], row["selected"]) == (
        True, False, "A_CORRECT", "A",
    )
    assert row["final_answer"] == "blue sky"
    assert row["factual_disagreement"] and row["ensemble_correct"]
    assert row["reason"].startswith("Fallback")
    assert (row["base_answer"], row["base_correct"], row["base_judged"]) == (None, None, None)
    assert row["similarity"] == 0.0 and row["semantic_disagreement"]


def test_failed_pair_is_an_error_row(spark):
    row = evaluate(spark, reply_b="ERROR: 500", reply_base="sky, blue!")
    assert row["status"] == "JUDGE_ERROR" and row["selected"] == "NONE"
    assert row["final_answer"] == "NO_CORRECT_ANSWER" and not row["ensemble_correct"]
    assert row["similarity"] == 0.0 and not row["semantic_disagreement"]
    assert row["base_correct"] and row["base_judged"]


def test_failed_judge_call(spark):
    assert evaluate(spark, verdict="ERROR: quota")["reason"] == "ERROR: quota"
    assert evaluate(spark, verdict=None)["status"] == "JUDGE_ERROR"


def test_unknown_status_is_kept_and_counts_as_wrong(spark):
    verdict = '{"answer_a_correct": true, ' + GOOD.replace("a_correct", "unsure") + "}"
    row = evaluate(spark, verdict=verdict)
    assert row["status"] == "UNSURE" and row["final_answer"] == "NO_CORRECT_ANSWER"
    assert not row["ensemble_correct"]


def test_failed_baseline_is_never_right(spark):
    verdict = '{"answer_a_correct": true, "baseline_correct": true, ' + GOOD + "}"
    row = evaluate(spark, verdict=verdict, reply_base="ERROR: x")
    assert row["base_judged"] is False and row["base_correct"] is False
    assert evaluate(spark, verdict=verdict, reply_base="red")["base_judged"] is True


def test_error_classes(spark):
    cases = {
        None: "ok", "Limit: tokens per day": "quota", "TPD reached": "quota",
        "httpd timeout": "transient", "Error 503": "transient", "bad key": "other",
        "429, used per day (tpd)": "quota",
    }
    assert values(spark, "string", cases, triage.error_class("x")) == list(cases.values())
    assert values(spark, "string", ["httpd"], triage.error_class("x", whole_word=False)) == ["quota"]


def test_request_json(spark):
    frame = spark.createDataFrame(
        [(1, "q?", "a", 'say "b"', None, "g")],
        "row_id long, question string, answer_a string, answer_b string, base_answer string,"
        " ground_truth string",
    )
    prompts = requests.judge_requests(frame, "full")
    assert "Baseline Answer: (no baseline answer available)" in prompts.first()["prompt"]
    body = requests.request_json(prompts, "m", "it's strict").selectExpr(
        "from_json(request, 'model string, messages array<struct<role: string, content: string>>,"
        " temperature double, max_tokens int') AS r"
    ).first()["r"]
    assert (body["model"], body["temperature"], body["max_tokens"]) == ("m", 0.3, 200)
    assert [m["role"] for m in body["messages"]] == ["system", "user"]
    assert body["messages"][0]["content"] == "it's strict"
    assert requests.judge_requests(frame, "baseline").count() == 0
