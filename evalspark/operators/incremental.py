"""Stopped and continued runs: resume a prefix, find what is pending, merge late results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import is_attempted, is_error, strip
from evalspark.operators.columns import add
from evalspark.sources import schema as S

FILLED = ("base_answer", "base_correct", "base_judged")

# Judged rows of two working agents that have no baseline answer yet.
NEEDS_FILL = (
    f"(NOT {is_attempted('base_answer')}"
    f" AND coalesce({strip('status')} NOT IN ('', 'nan', '{S.JUDGE_ERROR}'), false)"
    f" AND NOT {is_error('answer_a')} AND NOT {is_error('answer_b')})"
)


def defer_baseline(rows: DataFrame) -> DataFrame:
    """Leave the baseline of a run for later: its columns stay NULL, not false."""
    return rows.withColumn("reply_base", F.lit(None).cast("string"))


def pending_fill(results: DataFrame) -> DataFrame:
    """The rows a fill run still has to answer."""
    return results.where(NEEDS_FILL).select("row_id", "question", "ground_truth")


def remaining_work(results: DataFrame) -> DataFrame:
    """How many rows a fill run still has to answer."""
    return results.agg(F.expr(f"count_if({NEEDS_FILL})").alias("remaining"))


def last_attempts(replies: DataFrame, attempt: str | None = None) -> DataFrame:
    """One reply per ``row_id``: that of the highest ``attempt``, or the greatest of its cells."""
    cells = f"struct({', '.join(FILLED)})"
    order = f"struct({attempt}, {cells})" if attempt else cells
    last = replies.groupBy("row_id").agg(F.expr(f"max_by({cells}, {order})").alias("last"))
    return last.select("row_id", "last.*")


def fill_merge(results: DataFrame, replies: DataFrame, attempt: str | None = None) -> DataFrame:
    """Write the three baseline cells together where they are still needed.

    ``replies`` may hold several for one ``row_id``; the last by column ``attempt`` counts.
    Nothing else changes, and a second run with the same replies changes nothing.  Tables
    bucketed by ``row_id`` merge without a shuffle.
    """
    new = last_attempts(replies, attempt).selectExpr(
        "row_id", *(f"{c} AS new_{c}" for c in FILLED), "true AS replied"
    )
    joined = add(results, {"needed": NEEDS_FILL}).join(new, "row_id", "left")
    taken = {c: f"CASE WHEN needed AND replied THEN new_{c} ELSE {c} END" for c in FILLED}
    return add(joined, taken).select(*results.columns)


def resume_prefix(prior: DataFrame, questions: DataFrame) -> DataFrame:
    """The part of an earlier run that can be kept.

    Rows before the first judge error are kept, later ones are done again.  If any row
    before it does not carry the source's question, nothing is kept.

    The two first places, of an error and of a row with another question, are one aggregate
    with partial results, and the decision compares them; so the earlier run is read once
    for the decision and once for the rows that are kept.
    """
    source = questions.selectExpr("row_id", "question AS source_question")
    places = prior.select("row_id", "question", "status").join(source, "row_id", "left").agg(
        F.expr(f"min(CASE WHEN status = '{S.JUDGE_ERROR}' THEN row_id END)").alias("error"),
        F.expr("min(CASE WHEN NOT question <=> source_question THEN row_id END)").alias("mismatch"),
    )
    # Nothing lies before the least number; without an error nothing is cut off.
    end = "CASE WHEN mismatch < error OR (error IS NULL AND mismatch IS NOT NULL) THEN -9223372036854775808L ELSE error END"
    cut = places.select(F.expr(end)).scalar()
    return prior.where(F.coalesce(F.col("row_id") < cut, F.lit(True)))
