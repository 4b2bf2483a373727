"""One entry per operator: name -> callable(spark, directory of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.booleans import tri_state, two_state
from evalspark.functions.similarity import TextSimilarity, vector_cosine
from evalspark.functions.text import clean_output, is_truncated
from evalspark.operators import (
    association,
    groups,
    incremental,
    metrics,
    pipeline,
    references,
    reliability,
    requests,
    running,
    sampling,
    triage,
)
from evalspark.operators.joins import lookup
from evalspark.plans import views
from evalspark.sources import results as tables
from evalspark.sources.folders import fresh_path, stored_once
from evalspark.sources.records import numbered_parquet
from evalspark.sources.references import category_map
from evalspark.sources.results import head_rows as first_rows
from evalspark.sources.saved import SavedTable
from evalspark.streaming.collect import state_table

Query = Callable[[SparkSession, str], DataFrame]

# Sources counted as one bucket by ``bucket_association``.
LISTED = ("src0", "src3", "src7", "src11", "src15")
JUDGE_FLAGS = ("a_correct", "b_correct", "base_judged")

QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _over_results(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: operator(views.results(spark, sf_dir))


for _name, _operator in {
    "answer_validity": metrics.answer_validity,
    "eval_summary": metrics.eval_summary,
    "base_metrics": metrics.base_metrics,
    "data_quality": metrics.data_quality,
    "operational_rates": metrics.operational_rates,
    "disagreement_groups": groups.disagreement_groups,
    "persona_compare": groups.persona_compare,
    "disagreement_breakdown": groups.disagreement_breakdown,
    "consensus_split": groups.consensus_split,
    "category_rank": groups.category_rank,
    "consensus_concentration": groups.consensus_concentration,
    "error_examples": groups.error_examples,
    "verdict_consistency": reliability.verdict_consistency,
}.items():
    _over_results(_name, _operator)


@_query
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.replies(spark, sf_dir).select("row_id", "question", "ground_truth")
    return first_rows(rows)


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    replied = ("reply_a", "reply_b", "reply_base", "verdict")
    return views.replies(spark, sf_dir).selectExpr(
        "row_id", *(f"{clean_output(c)} AS {c}" for c in replied)
    )


QUERIES["clean_output"] = _cleaned


@_query
def truncated_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).selectExpr(
        "row_id",
        f"{is_truncated('reply_b')} AS b_truncated",
        f"{is_truncated('reply_base')} AS base_truncated",
    )


@_query
def bool_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.flag_text(spark, sf_dir).selectExpr(
        "row_id", f"{tri_state('flag')} AS tri", f"{two_state('flag')} AS two"
    )


@_query
def error_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.error_triage(views.call_log(spark, sf_dir))


@_query
def error_triage_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.error_triage(views.call_log(spark, sf_dir), whole_word=False)


def _requests(kind: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = pipeline.clean_replies(views.replies(spark, sf_dir))
        return requests.judge_requests(rows, kind)

    return build


QUERIES["judge_requests"] = _requests("full")
QUERIES["judge_requests_agents"] = _requests("agents")
QUERIES["judge_requests_baseline"] = _requests("baseline")


def _verdicts(truthy: bool) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = views.replies(spark, sf_dir).select("row_id", "verdict")
        return pipeline.parse_verdicts(rows, truthy).drop("verdict")

    return build


QUERIES["verdict_parse"] = _verdicts(truthy=False)
QUERIES["verdict_parse_truthy"] = _verdicts(truthy=True)

RESOLVED = (
    "row_id", "a_correct", "b_correct", "factual_disagreement", "status", "selected",
    "reason", "final_answer", "ensemble_correct", "base_judged",
)


@_query
def verdict_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.results(spark, sf_dir).select(*RESOLVED)


@_query
def verdict_resolve_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.results(spark, sf_dir, truthy=True).select(*RESOLVED)


@_query
def base_similarity_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.clean_replies(views.replies(spark, sf_dir))
    similar = TextSimilarity()
    return similar.compared(rows, pipeline.BASELINE).selectExpr(
        "row_id", f"{pipeline.base_grade(similar)} AS base_correct"
    )


@_query
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.clean_replies(views.replies(spark, sf_dir))
    return pipeline.pair_similarity(rows).select(
        "row_id", "similarity", "semantic_disagreement"
    )


@_query
def pair_similarity_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = views.table(spark, sf_dir, "embeddings")
    after = vectors.selectExpr("vec_id - 1 AS vec_id", "embedding AS next")
    return vectors.join(after, "vec_id").selectExpr(
        "vec_id", f"round({vector_cosine('embedding', 'next')}, 6) AS similarity"
    )


@_query
def category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.replies(spark, sf_dir)
    judged = views.table(spark, sf_dir, "labels").selectExpr("doc_id AS row_id")
    known = category_map(rows.join(judged, "row_id", "left_semi"))
    return lookup(rows.select("row_id", "question"), known)


@_query
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.results(spark, sf_dir)


def _replies_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.grade_baseline(views.base_replies(spark, sf_dir))


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German replies have not come yet; every fifth call failed once and was tried again."""
    second = _replies_graded(spark, sf_dir).where("lang <> 'de'").selectExpr("*", "2 AS attempt")
    first = second.where("row_id % 5 = 0").selectExpr(
        "row_id", "'ERROR: 429' AS base_answer", "false AS base_correct",
        "false AS base_judged", "1 AS attempt",
    )
    replies = second.select(first.columns).unionByName(first)
    return incremental.fill_merge(views.results(spark, sf_dir), replies, "attempt")


@_query
def baseline_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies_graded(spark, sf_dir).select("row_id", "base_correct", "base_judged")


@_query
def pending_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.pending_fill(views.results(spark, sf_dir)).select("row_id", "question")


@_query
def fill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).select("row_id", "status", *incremental.FILLED)


@_query
def remaining_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.remaining_work(_filled(spark, sf_dir))


@_query
def deferred_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incremental.defer_baseline(views.replies(spark, sf_dir))
    return pipeline.evaluate(rows).select(
        "row_id", "status", "base_answer", "base_correct", "base_judged"
    )


@_query
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """While baseline rows are pending, and over the rows of documents that have run."""
    scopes = {"all": "true", "complete": "base_answer IS NOT NULL"}
    return metrics.head_to_head(views.results(spark, sf_dir), scopes)


@_query
def resume_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = views.results(spark, sf_dir).select("row_id", "question", "status")
    return incremental.resume_prefix(prior, views.replies(spark, sf_dir))


@_query
def resume_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source whose early rows changed language: how much of the prior run is kept."""
    prior = views.results(spark, sf_dir).select("row_id", "question", "status")
    changed = views.replies(spark, sf_dir).withColumn(
        "question", F.replace("question", F.lit("Which en"), F.lit("Which it"))
    )
    counts = [
        frame.agg(F.count("*").alias(name))
        for name, frame in (
            ("prior", prior),
            ("kept", incremental.resume_prefix(prior, changed)),
            ("kept_unchanged", incremental.resume_prefix(prior, views.replies(spark, sf_dir))),
        )
    ]
    return counts[0].select("prior", counts[1].scalar().alias("kept"), counts[2].scalar().alias("kept_unchanged"))


def _rounded(tested: DataFrame) -> DataFrame:
    p_values = ("fisher_p", "chi_square_p")
    return tested.withColumns({c: F.round(c, 4) for c in p_values})


@_query
def risk_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(association.risk_association(views.results(spark, sf_dir)))


@_query
def bucket_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(association.bucket_association(views.results(spark, sf_dir), LISTED))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.reference_labels(
        views.results(spark, sf_dir),
        views.references(spark, sf_dir),
        keep=("status", *JUDGE_FLAGS),
    )


@_query
def reference_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select(
        "row_id", "ref_agentA", "ref_agentB", "ref_baseline"
    )


@_query
def reference_label_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same labels with reference sets in shards, as for sets larger than a row."""
    texts = references.reference_texts(views.references(spark, sf_dir))
    return references.sharded_reference_labels(views.results(spark, sf_dir), texts, chars_per_shard=4096)


@_query
def reference_label_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.reference_labels_by_vector(*views.vector_raters(spark, sf_dir))


@_query
def rater_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.rater_long(_labels(spark, sf_dir))


@_query
def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = reliability.rater_agreement(references.rater_long(_labels(spark, sf_dir)))
    return cells.withColumn("cm", F.to_json("cm"))


@_query
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation is row by row, so only the picked rows are evaluated a second time.

    The pick is stored: all rows are labelled for it once, whatever asks for it afterwards."""
    picked = stored_once(sampling.pick_rows(_labels(spark, sf_dir)), "picked")
    replied = sampling.take_rows(views.replies(spark, sf_dir), picked)
    results = pipeline.evaluate(replied, keep=("category", "turn", "stratum"))
    return sampling.audit_sample(results, views.references(spark, sf_dir))


@_query
def question_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question set without row numbers: all documents, numbered by their place in the files."""
    rows = numbered_parquet(spark, f"{sf_dir}/documents.parquet")
    return rows.selectExpr("row_id", "doc_id", "lang", "length(text) AS n_letters")


STORED = (
    "row_id", "question", "similarity", "semantic_disagreement", "a_correct", "b_correct", "status", "selected",
    "reason", "ensemble_correct", "base_answer", "base_correct", "base_judged",
)


@_query
def csv_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored run written as quoted CSV of 17 columns, texts with their line breaks, and read back
    by many tasks, numbered by the position in the files."""
    path = fresh_path(spark, "results-csv")
    tables.export_csv(views.stored_run(spark, sf_dir).orderBy("row_id").select(*tables.RESULT_COLUMNS), path)
    return tables.read_results_csv(spark, path).selectExpr(*STORED, "md5(coalesce(answer_a, '')) AS answer_a_md5")


def _saved(spark: SparkSession, sf_dir: str) -> SavedTable:
    """A stored run saved in three batches, the second one twice."""
    results = views.stored_run(spark, sf_dir).select("row_id", *tables.RESULT_COLUMNS)
    saved = SavedTable(spark, fresh_path(spark, "saved"), results.schema)
    for batch in (0, 1, 1, 2):
        saved.append(results.where(f"pmod(row_id DIV 100, 3) = {batch}"), f"batch {batch}")
    return saved


@_query
def saved_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches appended as they come, one of them twice, then joined into larger files."""
    saved = _saved(spark, sf_dir)
    saved.compact()
    return saved.read().selectExpr(*STORED, "md5(coalesce(answer_a, '')) AS answer_a_md5")


@_query
def saved_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late baseline replies filled in twice, in the files that need them."""
    saved = _saved(spark, sf_dir)
    replies = views.late_replies(spark, sf_dir)
    for _ in range(2):
        saved.fill(replies, "attempt")
    return saved.read().select("row_id", "status", *incremental.FILLED)


def _running(metric: Callable[[DataFrame], DataFrame]) -> Query:
    """A stored run counted in three batches; the second one, half done, is counted again."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        results = views.stored_run(spark, sf_dir)
        states = state_table(spark, fresh_path(spark, "states"))
        for batch, part in (("0", "0"), ("1", "1 AND row_id % 2 = 0"), ("1", "1"), ("2", "2")):
            rows = results.where(f"pmod(row_id DIV 100, 3) = {part}")
            states.put(running.state_of(rows, batch), batch)
        return metric(states.read())

    return build


QUERIES["running_summary"] = _running(running.eval_summary)
QUERIES["running_groups"] = _running(running.disagreement_groups)
