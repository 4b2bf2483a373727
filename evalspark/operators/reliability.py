"""Can the judge be trusted?  Agreement with a second rater, and its own rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.booleans import is_true
from evalspark.functions.stats import kappa, percent
from evalspark.functions.text import quoted
from evalspark.operators.columns import add
from evalspark.operators.metrics import count
from evalspark.operators.pipeline import selection_of, status_of
from evalspark.sources import schema as S


def rater_agreement(
    judgments: DataFrame, agents: Sequence[str] = ("agentA", "agentB")
) -> DataFrame:
    """Agreement, kappa and confusion matrix for agents, baseline and overall.

    Input is ``who, judge, ref``.  In ``cm`` rows are the reference rater, columns the
    judge, each in the order true, false.
    """
    names = ", ".join(map(quoted, agents))
    buckets = add(
        judgments, {"bucket": f"CASE WHEN who IN ({names}) THEN 'agents' ELSE 'baseline' END"}
    )
    cells = {
        "n": "true",
        "tt": "ref AND judge",
        "tf": "ref AND NOT judge",
        "ft": "NOT ref AND judge",
        "ff": "NOT ref AND NOT judge",
    }
    counted = buckets.rollup("bucket").agg(
        *(F.expr(f"count_if({sql})").alias(name) for name, sql in cells.items()),
        F.expr("grouping(bucket)").alias("is_total"),
    )
    return counted.where("n > 0").selectExpr(
        "CASE WHEN is_total = 1 THEN 'overall' ELSE bucket END AS grp",
        "n",
        "tt + ff AS agree",
        f"{percent('tt + ff', 'n')} AS agree_pct",
        f"{kappa('tt', 'tf', 'ft', 'ff')} AS kappa",
        "array(array(tt, tf), array(ft, ff)) AS cm",
    )


def verdict_consistency(results: DataFrame) -> DataFrame:
    """How many judged rows break each rule that ties the verdict's fields together."""
    a, b = is_true("a_correct"), is_true("b_correct")
    expected = add(results, {"expected": status_of(a, b)})
    broken = {
        "bad_status": "NOT status <=> expected",
        "bad_selected": f"NOT upper(selected) <=> {selection_of('expected')}",
        "bad_factual": f"{is_true('factual_disagreement')} <> ({a} <> {b})",
        "bad_ensemble": f"{is_true('ensemble_correct')} <> (expected <> '{S.BOTH_WRONG}')",
    }
    checked = expected.selectExpr(
        f"NOT status <=> '{S.JUDGE_ERROR}' AS is_judged",
        *(f"{sql} AS {name}" for name, sql in broken.items()),
    )
    counted = count(
        checked,
        {"judged": "is_judged", "consistent": f"is_judged AND NOT ({' OR '.join(broken)})"}
        | {name: f"is_judged AND {name}" for name in broken},
    )
    return add(counted, {"consistent_pct": percent("consistent", "judged")})
