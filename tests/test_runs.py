"""Stopped and continued runs, skewed lookups, samples, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators import groups, incremental, metrics, pipeline, references, sampling
from evalspark.operators.joins import hot_keys, lookup
from evalspark.sources import results as files
from evalspark.sources.references import category_map, read_category_map, reference_sets
from evalspark.sources.schema import RESULT_COLUMNS
from evalspark.sources.stats import read_stats, write_stats
from evalspark.streaming import collect as streams

REPLIES = (
    "row_id long, question string, ground_truth string, reply_a string, reply_b string,"
    " reply_base string, verdict string"
)


def replies(spark, n=6):
    rows = [
        (i, f"q{i}", "blue sky", 'line one\n"quoted", two', f"b\\{i}", None if i % 2 else "blue",
         "ERROR: 503" if i == 4 else "none")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, REPLIES)


def test_resume(spark):
    prior = pipeline.evaluate(replies(spark))
    questions = replies(spark).select("row_id", "question")
    kept = incremental.resume_prefix(prior, questions)
    assert sorted(r["row_id"] for r in kept.collect()) == [0, 1, 2, 3]

    late = questions.selectExpr("row_id", "CASE WHEN row_id = 5 THEN 'x' ELSE question END AS question")
    assert incremental.resume_prefix(prior, late).count() == 4
    early = questions.where("row_id <> 2")
    assert incremental.resume_prefix(prior, early).count() == 0
    clean = prior.where("row_id < 4")
    assert incremental.resume_prefix(clean, questions).count() == 4
    broken = prior.where("row_id >= 4")
    assert incremental.resume_prefix(broken, questions).count() == 0


def test_fill_is_idempotent_and_touches_nothing_else(spark):
    prior = pipeline.evaluate(replies(spark))
    late = spark.createDataFrame(
        [(0, "new", True, True), (1, "new", True, False), (4, "new", True, True)],
        "row_id long, base_answer string, base_correct boolean, base_judged boolean",
    )
    once = incremental.fill_merge(prior, late)
    twice = incremental.fill_merge(once, late)
    key = lambda row: row["row_id"]
    assert sorted(once.collect(), key=key) == sorted(twice.collect(), key=key)
    filled = {r["row_id"]: r["base_answer"] for r in once.collect()}
    assert filled == {0: "blue", 1: "new", 2: "blue", 3: None, 4: "blue", 5: None}
    assert [r["row_id"] for r in incremental.pending_fill(once).collect()] == [3, 5]
    assert incremental.remaining_work(once).first()["remaining"] == 2


def test_all_pending_and_no_rows(spark):
    deferred = pipeline.evaluate(incremental.defer_baseline(replies(spark)))
    row = metrics.base_metrics(deferred).first()
    assert row["attempted"] == 0 and row["similar_pct"] is None
    assert row["difference_judged_pp"] is None
    assert metrics.head_to_head(deferred).first()["judged_pct"] is None
    nothing = metrics.eval_summary(deferred.where("row_id < 0")).first()
    assert nothing["total"] == 0 and nothing["ensemble_pct"] is None


def test_parts_add_up(spark):
    results = pipeline.evaluate(replies(spark))
    row = metrics.data_quality(results).first()
    assert row["valid"] + row["dropped"] == row["total"] == 6


def test_hot_keys_are_spread_and_the_join_is_whole(spark):
    rows = spark.range(3000).selectExpr(
        "id AS row_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 500) END AS question"
    )
    table = rows.select("question").distinct().selectExpr("question", "concat(question, '!') AS v")
    table = table.where("question <> 'k7'")
    spread = {r["tasks"] for r in hot_keys(rows, "question", 100).collect()}
    assert spread == {10}
    for how in ("left", "inner"):
        ours = lookup(rows, table, "question", how, rows_per_task=100)
        plain = rows.join(table, "question", how)
        assert ours.columns == plain.columns == lookup(rows, table, "question", how).columns
        assert sorted(map(tuple, ours.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_any_number_of_hot_keys(spark):
    rows = spark.range(24_000).selectExpr("id AS row_id", "concat('k', id % 12000) AS question")
    assert hot_keys(rows, "question", 1).count() == 12_000
    table = rows.select("question").distinct().selectExpr("question", "concat(question, '!') AS v")
    assert lookup(rows, table, rows_per_task=1).where("v = concat(question, '!')").count() == 24_000


def test_reference_labels_equal_brute_force(spark):
    def bag(text):
        return {w: text.split().count(w) for w in text.split()}

    def closest(answer, texts):
        a = bag(answer)
        return max(
            (sum(n * bag(t).get(w, 0) for w, n in a.items())
             / max(sum(n * n for n in bag(t).values()), 1) ** 0.5 for t in texts)
        )

    answers = ["red red blue", "green", "ERROR: x", "", "blue sea sea", "none of these"]
    sets = {
        "q0": (["red sky", "blue"], ["green sea", ""]),
        "q1": (["sea"], ["blue sea", "sky sky"]),
        "q2": ([], ["red"]),
    }
    rows = [(i, f"q{i % 4}", answers[i % 6], answers[(i + 1) % 6], answers[(i + 2) % 6])
            for i in range(24)]
    results = spark.createDataFrame(
        rows, "row_id long, question string, answer_a string, answer_b string, base_answer string"
    )
    refs = spark.createDataFrame(
        [(q, c, i) for q, (c, i) in sets.items()],
        "question string, correct array<string>, incorrect array<string>",
    )
    found = {r["row_id"]: r for r in references.reference_labels(results, refs, rows_per_task=2).collect()}
    assert len(found) == len(rows)
    for row_id, question, *texts in rows:
        correct, incorrect = sets.get(question, ([], []))
        for text, who in zip(texts, ("agentA", "agentB", "baseline"), strict=True):
            expected = None
            if correct and incorrect and text and not text.startswith("ERROR:"):
                expected = closest(text, correct) > closest(text, incorrect)
            assert found[row_id][f"ref_{who}"] is expected


def test_last_reference_set_wins(spark):
    rows = spark.createDataFrame(
        [(1, "q", ["a"], ["b"], "x"), (2, "q", ["c"], ["d"], "y")],
        "row_id long, question string, correct array<string>, incorrect array<string>, category string",
    )
    assert reference_sets(rows).collect() == [("q", ["c"], ["d"])]
    assert category_map(rows).collect() == [("q", "y")]


def test_sample_shape(spark):
    statuses = ["A_CORRECT", "B_CORRECT", "BOTH_CORRECT", "BOTH_WRONG"]
    labels = spark.range(400).selectExpr(
        "id AS row_id",
        f"get(array({', '.join(repr(s) for s in statuses)}, 'JUDGE_ERROR'), int(id % 5)) AS status",
        "true AS a_correct", "true AS b_correct", "CAST(NULL AS boolean) AS base_judged",
        "id % 2 = 0 AS ref_agentA", "CAST(NULL AS boolean) AS ref_agentB", "true AS ref_baseline",
    )
    picked = sampling.pick_rows(labels.withColumn("base_judged", labels.a_correct)).collect()
    turns = [(r["turn"], r["stratum"]) for r in picked]
    expected = [(1, s) for s in (1, 2, 3, 4) for _ in range(5)]
    expected += [(2, s) for s, n in ((1, 3), (2, 3), (3, 3), (4, 1)) for _ in range(n)]
    assert turns == expected
    with pytest.raises(ValueError):
        sampling.pick_rows(labels, cap=10)


def test_result_files(spark, tmp_path):
    results = pipeline.evaluate(replies(spark))
    files.write_results(results, str(tmp_path / "parquet"))
    stored = files.read_results(spark, str(tmp_path / "parquet"))
    assert stored.columns == ["row_id", *RESULT_COLUMNS]
    order = lambda frame: sorted(map(tuple, frame.collect()))
    files.export_csv(stored, str(tmp_path / "csv"))
    again = files.read_results_csv(spark, str(tmp_path / "csv"))
    assert sorted(r["answer_a"] for r in again.collect()) == sorted(
        r["answer_a"] for r in stored.collect()
    )
    flags = lambda frame: sorted((r["row_id"], str(r["a_correct"]), str(r["base_judged"])) for r in frame.collect())
    assert flags(again) == flags(stored) and any("None" in f for f in flags(again))
    files.export_csv(stored.drop("reason"), str(tmp_path / "other"))
    assert files.read_results_csv(spark, str(tmp_path / "other"), on_mismatch="empty").count() == 0
    with pytest.raises(ValueError):
        files.read_results_csv(spark, str(tmp_path / "other"))
    assert files.guard_schema(stored).count() == 6
    for wrong in (stored.drop("reason"), stored.withColumn("similarity", stored.similarity.cast("string"))):
        wrong.write.parquet(str(tmp_path / f"wrong{len(wrong.columns)}"))
        with pytest.raises(ValueError):
            files.read_results(spark, str(tmp_path / f"wrong{len(wrong.columns)}"))
        assert files.read_results(spark, str(tmp_path / f"wrong{len(wrong.columns)}"), "empty").count() == 0
    assert order(files.head_rows(stored.select("row_id"), 2)) == [(0,), (1,)]
    named = stored.selectExpr("row_id", "question", "ground_truth AS best_answer")
    assert files.select_questions(named).columns == ["row_id", "question", "ground_truth"]


def test_text_survives_csv(spark, tmp_path):
    rows = pipeline.evaluate(replies(spark)).withColumn("question", F.lit("  padded  "))
    rows = rows.withColumn("reason", F.lit("\n\tline, \"quoted\" \\\n")).withColumn("selected", F.lit(""))
    files.export_csv(rows, str(tmp_path / "csv"))
    again = files.read_results_csv(spark, str(tmp_path / "csv"))
    shown = ["row_id", "question", "reason", "answer_a", "answer_b", "ground_truth", "similarity"]
    assert sorted(map(tuple, again.select(shown).collect())) == sorted(map(tuple, rows.select(shown).collect()))
    audit = sampling.audit_sample(
        rows.selectExpr("*", "'c' AS category", "1 AS turn", "1 AS stratum"),
        spark.createDataFrame([], "question string, correct array<string>"),
    )
    files.export_csv(audit, str(tmp_path / "audit"))
    stored = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path / "audit"))
    assert stored.columns == audit.columns and stored.count() == 6
    assert {r["question"] for r in stored.collect()} == {r["question"] for r in audit.collect()}


def test_the_last_attempt_counts(spark):
    prior = pipeline.evaluate(replies(spark))
    late = spark.createDataFrame(
        [(1, "first", True, True, 1), (1, "last", False, True, 3), (1, "second", True, True, 2), (3, "x", True, True, 1), (3, "x", True, True, 1)],
        "row_id long, base_answer string, base_correct boolean, base_judged boolean, attempt int",
    )
    merged = incremental.fill_merge(prior, late, "attempt").collect()
    assert len(merged) == 6
    assert {r["row_id"]: r["base_answer"] for r in merged if r["row_id"] in (1, 3)} == {1: "last", 3: "x"}
    assert len(incremental.fill_merge(prior, late).collect()) == 6


def test_unused_replies_are_not_read(spark, tmp_path):
    replies(spark).write.parquet(str(tmp_path / "replies"))
    stored = pipeline.evaluate(spark.read.parquet(str(tmp_path / "replies")).withColumn("category", F.lit("c")), keep=("category",))
    plans = {
        "groups": groups.disagreement_groups(stored), "persona": groups.persona_compare(stored),
        "rates": metrics.operational_rates(stored), "similarity": stored.select("row_id", "similarity"),
    }
    for name, frame in plans.items():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "reply_a" in plan or name == "rates"
        assert "reply_base" not in plan, name


def test_reference_labels_shuffle_answers_once(spark, tmp_path):
    results = pipeline.evaluate(replies(spark))
    results.write.parquet(str(tmp_path / "results"))
    refs = spark.createDataFrame([("q1", ["a"], ["b"])], "question string, correct array<string>, incorrect array<string>")
    refs.write.parquet(str(tmp_path / "refs"))
    frames = (spark.read.parquet(str(tmp_path / name)) for name in ("results", "refs"))
    plan = references.reference_labels(*frames)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan and plan.count("Exchange") <= 2


def test_stats_and_category_files(spark, tmp_path):
    summary = metrics.eval_summary(pipeline.evaluate(replies(spark)))
    write_stats(summary, str(tmp_path / "stats"))
    assert read_stats(spark, str(tmp_path / "stats")).first()["total"] == 6
    (tmp_path / "map.json").write_text(json.dumps({"q1": "Law", "q2": "Health"}))
    found = read_category_map(spark, str(tmp_path / "map.json")).collect()
    assert sorted(map(tuple, found)) == [("q1", "Law"), ("q2", "Health")]


def test_stream_continues_and_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = replies(spark, 12)
    for part in ("row_id < 5", "row_id >= 5"):
        rows.where(part).write.mode("append").parquet(source)
        streams.collect(streams.reply_stream(spark, source, 1), out, name="stream").awaitTermination()
    stored = spark.read.parquet(out)
    batch = pipeline.evaluate(rows)
    assert sorted(map(tuple, stored.select(batch.columns).collect()), key=str) == sorted(
        map(tuple, batch.collect()), key=str
    )
