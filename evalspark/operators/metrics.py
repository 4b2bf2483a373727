"""Correctness and disagreement metrics: one pass, one aggregate each.

Counts are exact and rates are unrounded; a rate over nothing is NULL.  "Is true" and "is
false" are both tested, so an unknown flag counts for neither.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.stats import percent
from evalspark.functions.text import is_attempted, is_error, is_failed
from evalspark.operators.columns import add
from evalspark.sources import schema as S

VALID = f"(NOT {is_failed('answer_a')} AND NOT {is_failed('answer_b')})"
BOTH_WRONG = f"coalesce(status = '{S.BOTH_WRONG}', false)"
ATTEMPTED = is_attempted("base_answer")


def count(rows: DataFrame, conditions: Mapping[str, str], *keys: str) -> DataFrame:
    """Count the rows meeting each condition; partial counts before any shuffle."""
    counts = (F.expr(f"count_if({sql})").alias(name) for name, sql in conditions.items())
    return rows.groupBy(*keys).agg(*counts)


def answer_validity(rows: DataFrame) -> DataFrame:
    """Per row: which answers failed, whether the pair counts, whether the baseline ran."""
    return rows.selectExpr(
        "row_id",
        f"{is_failed('answer_a')} AS a_failed",
        f"{is_failed('answer_b')} AS b_failed",
        f"{VALID} AS valid",
        f"{ATTEMPTED} AS base_attempted",
        f"{is_failed('base_answer')} AS base_failed",
    )


_OF_VALID = {
    "semantic_n": "semantic_disagreement",
    "factual_n": "factual_disagreement",
    "a_correct_n": "a_correct",
    "b_correct_n": "b_correct",
    "both_correct_n": f"status = '{S.BOTH_CORRECT}'",
    "both_wrong_n": f"status = '{S.BOTH_WRONG}'",
    "abstained_n": f"final_answer = '{S.NO_ANSWER}'",
    "ensemble_n": "ensemble_correct",
    "agree_n": "NOT semantic_disagreement",
    "semantic_wrong_n": "semantic_disagreement AND NOT ensemble_correct",
    "factual_wrong_n": "factual_disagreement AND NOT ensemble_correct",
    "agree_both_wrong_n": f"NOT semantic_disagreement AND status = '{S.BOTH_WRONG}'",
    "disagree_both_wrong_n": f"semantic_disagreement AND status = '{S.BOTH_WRONG}'",
}
_SUMMARY_RATES = {
    "semantic_pct": ("semantic_n", "valid"),
    "factual_pct": ("factual_n", "valid"),
    "a_correct_pct": ("a_correct_n", "valid"),
    "b_correct_pct": ("b_correct_n", "valid"),
    "both_correct_pct": ("both_correct_n", "valid"),
    "both_wrong_pct": ("both_wrong_n", "valid"),
    "abstained_pct": ("abstained_n", "valid"),
    "ensemble_pct": ("ensemble_n", "valid"),
    "semantic_precision": ("semantic_wrong_n", "semantic_n"),
    "factual_precision": ("factual_wrong_n", "factual_n"),
    "agree_both_wrong_pct": ("agree_both_wrong_n", "agree_n"),
    "disagree_both_wrong_pct": ("disagree_both_wrong_n", "semantic_n"),
}
SUMMARY = {"total": "true", "valid": "is_valid"} | {
    name: f"is_valid AND {condition}" for name, condition in _OF_VALID.items()
}


def eval_summary(results: DataFrame) -> DataFrame:
    """One row: totals, rates over valid rows, and the precision of both disagreements."""
    return summary_of(count(add(results, {"is_valid": VALID}), SUMMARY))


def summary_of(counted: DataFrame) -> DataFrame:
    """The summary of rows with the counts of ``SUMMARY``."""
    return add(counted, {name: percent(*parts) for name, parts in _SUMMARY_RATES.items()})


_ANSWERED = f"{ATTEMPTED} AND NOT {is_error('base_answer')}"
AGAINST_BASE = {
    "valid": "true",
    "ensemble_n": "ensemble_correct",
    "attempted": ATTEMPTED,
    "similar_n": f"{_ANSWERED} AND base_correct",
    "judged_n": f"{_ANSWERED} AND base_judged",
    "pending": f"NOT {ATTEMPTED}",
}


def base_metrics(results: DataFrame) -> DataFrame:
    """Baseline correctness over attempted rows; differences only once nothing is pending."""
    return base_of(count(results.where(VALID), AGAINST_BASE))


def base_of(counted: DataFrame) -> DataFrame:
    """The baseline's metrics of rows with the counts of ``AGAINST_BASE``."""
    rates = {
        "similar_pct": percent("similar_n", "attempted"),
        "judged_pct": percent("judged_n", "attempted"),
        "ensemble_pct": percent("ensemble_n", "valid"),
    }
    complete = "pending = 0 AND attempted > 0"
    differences = {
        f"difference_{name}_pp": f"CASE WHEN {complete} THEN ensemble_pct - {name}_pct END"
        for name in ("similar", "judged")
    }
    return add(add(counted, rates), differences)


def head_to_head(results: DataFrame, scopes: Mapping[str, str] | None = None) -> DataFrame:
    """Ensemble against baseline over all valid rows; baseline side NULL while pending.

    ``scopes`` maps names to conditions; each gives a row of its own, all from one pass.
    """
    scopes = scopes or {"all": "true"}
    conditions = {
        f"{scope}_{name}": f"({chosen}) AND {sql}"
        for scope, chosen in scopes.items()
        for name, sql in AGAINST_BASE.items()
    }
    cells = ", ".join(
        f"'{scope}', " + ", ".join(f"{scope}_{name}" for name in AGAINST_BASE) for scope in scopes
    )
    names = ", ".join(("scope", *AGAINST_BASE))
    counted = count(results.where(VALID), conditions).selectExpr(
        f"stack({len(scopes)}, {cells}) AS ({names})"
    )
    rates = {
        "judged_pct": percent("judged_n", "valid"),
        "similar_pct": percent("similar_n", "valid"),
        "difference_pp": percent("ensemble_n - judged_n", "valid"),
    }
    return counted.selectExpr(
        "scope", "valid", "ensemble_n", "attempted", "pending",
        f"{percent('ensemble_n', 'valid')} AS ensemble_pct",
        *(f"CASE WHEN pending = 0 THEN {sql} END AS {name}" for name, sql in rates.items()),
    )


QUALITY = {
    "total": "true",
    "valid": "is_valid",
    "dropped": "NOT is_valid",
    "judge_errors": f"is_valid AND status = '{S.JUDGE_ERROR}'",
    "base_errors": f"is_valid AND {is_error('base_answer')}",
}


def data_quality(results: DataFrame) -> DataFrame:
    """Totals, dropped rows, and errors among the valid rows."""
    return count(add(results, {"is_valid": VALID}), QUALITY)


OPERATIONS = {
    "total": "true",
    "judged": f"NOT status <=> '{S.JUDGE_ERROR}'",
    "fallback": f"contains(lower(reason), '{S.FALLBACK_MARK}')",
    "judge_errors": f"status = '{S.JUDGE_ERROR}'",
}


def operational_rates(results: DataFrame) -> DataFrame:
    """How often the judge answered, answered readably, or had to be replaced."""
    return operations_of(count(results, OPERATIONS))


def operations_of(counted: DataFrame) -> DataFrame:
    """The rates of rows with the counts of ``OPERATIONS``."""
    rates = {
        "clean_parse_pct": percent("clean_parse", "judged"),
        "fallback_pct": percent("fallback", "judged"),
        "judge_error_pct": percent("judge_errors", "total"),
    }
    return add(add(counted, {"clean_parse": "judged - fallback"}), rates)
