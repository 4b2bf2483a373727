"""Counts a batch, kept while a run goes on, and reference sets in shards."""

import random

import pytest
from evalspark.operators import groups, metrics, pipeline, references, running
from evalspark.streaming import collect as streams
from test_runs import REPLIES

METRICS = {
    running.eval_summary: metrics.eval_summary,
    running.base_metrics: metrics.base_metrics,
    running.data_quality: metrics.data_quality,
    running.operational_rates: metrics.operational_rates,
    running.disagreement_groups: groups.disagreement_groups,
}


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def same(states, results):
    for ours, whole in METRICS.items():
        assert ours(states).columns == whole(results).columns
        assert rows_of(ours(states)) == rows_of(whole(results))


def judged(spark, n=40):
    """Replies with verdicts of all kinds."""
    dice, rows = random.Random(n), []
    for i in range(n):
        word = dice.choice(["A_CORRECT", "B_CORRECT", "BOTH_CORRECT", "BOTH_WRONG"])
        a, b = dice.choice(["true", "false", "null"]), dice.choice(["true", "false"])
        verdict = f'{{"answer_a_correct": {a}, "answer_b_correct": {b}, "selection_status": "{word}", "baseline_correct": true}}'
        rows.append((i, f"q{i}", "blue sky", dice.choice(["blue sky", "red", "ERROR: x"]), dice.choice(["blue sky", "green", ""]),
                     dice.choice([None, "blue", "ERROR: 429"]), dice.choice([verdict, "none", "ERROR: 503"])))
    return spark.createDataFrame(rows, REPLIES)


def test_sums_over_batches(spark, tmp_path):
    results = pipeline.evaluate(judged(spark))
    table = streams.state_table(spark, str(tmp_path / "states"))
    same(table.read(), results.where("row_id < 0"))  # before the first batch
    for k in range(4):
        table.put(running.state_of(results.where(f"row_id % 4 = {k} AND row_id < 20"), str(k)), str(k))
    same(table.read(), results.where("row_id < 20"))
    for k in (2, 0, 1, 3, 3):  # batches that are counted again replace their row
        table.put(running.state_of(results.where(f"row_id % 4 = {k}"), str(k)), str(k))
    same(table.read(), results)
    assert table.read().count() == 4


def test_stream_fills_the_states(spark, tmp_path):
    source, states, place = (str(tmp_path / x) for x in ("in", "states", "checkpoint"))
    given = judged(spark)
    for turn in range(2):
        given.where(f"row_id % 2 = {turn}").repartition(3).write.mode("append").parquet(source)
        streams.collect_metrics(streams.reply_stream(spark, source, 2), states, place).awaitTermination()
        same(streams.state_table(spark, states).read(), pipeline.evaluate(given.where(f"row_id % 2 <= {turn}")))
    streams.collect_metrics(streams.reply_stream(spark, source, 2), states, place).awaitTermination()  # nothing new
    same(streams.state_table(spark, states).read(), pipeline.evaluate(given))


@pytest.mark.parametrize("size", [1, 12, 60, 1 << 20])
def test_labels_are_the_same_with_any_shards(spark, size):
    dice = random.Random(7)
    words = ["red", "blue", "sea", "sky", "green", "sun"]

    def text():
        return " ".join(dice.choice(words) for _ in range(dice.randint(0, 6)))

    answers = [(i, f"q{i % 7}", text(), dice.choice([text(), "ERROR: x", ""]), dice.choice([text(), None])) for i in range(80)]
    results = spark.createDataFrame(answers, "row_id long, question string, answer_a string, answer_b string, base_answer string")
    sets = [(f"q{k}", [text() for _ in range(dice.randint(0, 9))], [text() for _ in range(dice.randint(0, 9))]) for k in range(6)]
    sets += [("q9", ["red"], ["blue"]), ("q8", None, ["red"])]
    given = spark.createDataFrame(sets, "question string, correct array<string>, incorrect array<string>")
    texts = references.reference_texts(given)
    whole = references.reference_labels(results, given)
    for tasks in (None, 3):
        ours = references.sharded_reference_labels(results, texts.unionByName(texts), chars_per_shard=size, rows_per_task=tasks)
        assert rows_of(ours.select(*whole.columns)) == rows_of(whole)
