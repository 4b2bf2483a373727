"""A small stratified sample for human review, oversampling rater disagreements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import quoted, shorten
from evalspark.operators.columns import add
from evalspark.operators.references import raters_disagree
from evalspark.sources import schema as S


def pick_rows(
    labels: DataFrame,
    statuses: Sequence[str] = S.JUDGED_STATUSES,
    disagreeing: int = 5,
    agreeing: int = 3,
    cap: int = 30,
) -> DataFrame:
    """Choose row ids: the first rows per status where the raters disagree, then fill up to
    ``cap`` with the first agreeing rows per status, in status order.

    Each task keeps only the first few rows of a stratum before the shuffle, so four
    strata of any size stay cheap.
    """
    if cap < disagreeing * len(statuses):
        raise ValueError("the cap must leave room for every disagreeing row")
    listed = ", ".join(map(quoted, statuses))
    strata = labels.where(f"status IN ({listed})").selectExpr(
        "row_id",
        f"CASE WHEN {raters_disagree()} THEN 1 ELSE 2 END AS turn",
        f"array_position(array({listed}), status) AS stratum",
    )
    placed = add(
        strata, {"place": "row_number() OVER (PARTITION BY turn, stratum ORDER BY row_id)"}
    )
    return (
        placed.where(f"place <= {max(disagreeing, agreeing)}")
        .where(f"place <= CASE turn WHEN 1 THEN {disagreeing} ELSE {agreeing} END")
        .orderBy("turn", "stratum", "row_id")
        .limit(cap)
        .select("row_id", "turn", "stratum")
    )


def take_rows(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """The picked rows with their place.  ``picked`` is a stored sample, a few rows: their ids are
    a filter that reaches the source of the wide table, so that no other row is computed again."""
    ids = [row["row_id"] for row in picked.select("row_id").collect()]
    return rows.where(F.col("row_id").isin(ids)).join(picked, "row_id")


def audit_sample(rows: DataFrame, references: DataFrame, cap: int = 30) -> DataFrame:
    """The 14 review columns for results that ``take_rows`` picked, long texts shortened.

    ``cap`` is that of ``pick_rows``: the order is a top-k, which samples no bounds.
    """
    wanted = rows.select("question").distinct()
    sets = references.select("question", "correct").join(wanted, "question", "left_semi")
    return (
        rows.join(sets, "question", "left")
        .orderBy("turn", "stratum", "row_id")
        .limit(cap)
        .selectExpr(
            "row_id AS row",
            "category",
            f"{shorten('question', 120)} AS question",
            f"{shorten('answer_a', 160)} AS answer_a",
            f"{shorten('answer_b', 160)} AS answer_b",
            f"{shorten('base_answer', 160)} AS base_answer",
            f"{shorten('ground_truth', 120)} AS ground_truth",
            f"{shorten(_JOINED, 200)} AS correct_answers",
            "a_correct AS judge_a_correct",
            "b_correct AS judge_b_correct",
            "base_judged AS base_correct_judged",
            "status AS judge_status",
            f"{shorten('reason', 200)} AS judge_reason",
            "turn = 1 AS ref_disagreed_somewhere",
        )
    )


_JOINED = "coalesce(array_join(correct, ' | '), '')"
