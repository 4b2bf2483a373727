"""Comparisons between groups of rows: agreement or not, category by category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.booleans import is_true
from evalspark.functions.stats import percent
from evalspark.functions.text import quoted, shorten
from evalspark.operators.columns import add
from evalspark.operators.metrics import BOTH_WRONG, VALID, count
from evalspark.sources import schema as S

APART = is_true("semantic_disagreement")


WRONG = {
    "n": "true",
    "both_wrong": BOTH_WRONG,
    "ensemble_wrong": f"NOT {is_true('ensemble_correct')}",
    "a_wrong": f"NOT {is_true('a_correct')}",
    "b_wrong": f"NOT {is_true('b_correct')}",
}


def disagreement_groups(results: DataFrame) -> DataFrame:
    """Wrong-answer counts and rates where the agents disagree, agree, and overall.

    An unknown flag counts as agreement and as wrong.
    """
    pairs = add(
        results.where(VALID), {"pair": f"CASE WHEN {APART} THEN 'disagree' ELSE 'agree' END"}
    )
    counts = (F.expr(f"count_if({sql})").alias(name) for name, sql in WRONG.items())
    groups = pairs.rollup("pair").agg(*counts, F.expr("grouping(pair)").alias("is_total"))
    return groups_of(groups.withColumn("grp", F.expr("CASE WHEN is_total = 1 THEN 'all' ELSE pair END")))


def groups_of(counted: DataFrame) -> DataFrame:
    """The rates of rows with a name ``grp`` and the counts of ``WRONG``."""
    return counted.selectExpr(
        "grp", "n", "both_wrong", "ensemble_wrong", "a_wrong + b_wrong AS agent_wrong",
        f"{percent('both_wrong', 'n')} AS both_wrong_pct",
        f"{percent('ensemble_wrong', 'n')} AS ensemble_wrong_pct",
        f"{percent('a_wrong + b_wrong', 'n * 2')} AS agent_wrong_pct",
    )


def persona_compare(results: DataFrame) -> DataFrame:
    """How the two agents compare: verdicts, picks, similarity and the A-minus-B gap."""
    conditions = {
        "n": "true",
        "a_correct": "a_correct",
        "b_correct": "b_correct",
        "same_verdict": "a_correct = b_correct",
        "both_right": "a_correct AND b_correct",
        "both_wrong": "NOT a_correct AND NOT b_correct",
        "exactly_one_right": "a_correct <> b_correct",
    } | {f"pick_{p.lower()}": f"selected = '{p}'" for p in S.SELECTION_OF.values()}
    counted = results.where(VALID).agg(
        *(F.expr(f"count_if({sql})").alias(name) for name, sql in conditions.items()),
        F.expr("round(avg(similarity), 6)").alias("mean_similarity"),
    )
    return add(
        counted,
        {
            "same_verdict_pct": percent("same_verdict", "n"),
            "a_minus_b_pp": percent("a_correct - b_correct", "n"),
        },
    )


def disagreement_breakdown(results: DataFrame) -> DataFrame:
    """Rows by agreement and by how many agents the flags call right."""
    right = {"n_right": "int(a_correct) + int(b_correct)"}
    rows = add(results.where(VALID), right)
    return count(rows, {"n": "true"}, "semantic_disagreement", "n_right")


def consensus_split(results: DataFrame) -> DataFrame:
    """Both-wrong rows split into consensus (agreeing) and divergent ones, with shares."""
    counted = count(
        results.where(VALID),
        {
            "n": "true",
            "both_wrong": BOTH_WRONG,
            "consensus": f"{BOTH_WRONG} AND NOT {APART}",
            "divergent": f"{BOTH_WRONG} AND {APART}",
        },
    )
    shares = {
        f"{kind}_of_{name}_pct": percent(kind, whole)
        for kind in ("consensus", "divergent")
        for name, whole in (("wrong", "both_wrong"), ("all", "n"))
    }
    return add(counted, shares)


def _per_category(results: DataFrame, name: str, condition: str, min_rows: int) -> DataFrame:
    rows = results.where(f"{VALID} AND category IS NOT NULL")
    counted = count(rows, {"n": "true", name: condition}, "category")
    return add(counted.where(f"n >= {min_rows}"), {"rate": percent(name, "n")})


def category_rank(results: DataFrame, k: int = 5, min_rows: int = 10) -> DataFrame:
    """The ``k`` best and ``k`` worst categories by correctness, ties by name."""
    rates = _per_category(results, "correct", "ensemble_correct", min_rows)
    best = rates.orderBy(F.desc("rate"), "category").limit(k)
    worst = rates.orderBy("rate", "category").limit(k)
    return add(best, {"end": "'best'"}).unionByName(add(worst, {"end": "'worst'"}))


def consensus_concentration(results: DataFrame, k: int = 8, min_rows: int = 5) -> DataFrame:
    """The ``k`` categories where agreeing agents are most often both wrong."""
    shared = f"{BOTH_WRONG} AND NOT {APART}"
    rates = _per_category(results, "consensus", shared, min_rows)
    return rates.orderBy(F.desc("rate"), "category").limit(k)


def error_examples(
    results: DataFrame, categories: Sequence[str] | None = None, limit: int = 170
) -> DataFrame:
    """The first consensus error of each (listed) category, its answer shortened."""
    wanted = f"{VALID} AND {BOTH_WRONG} AND NOT {APART} AND category IS NOT NULL"
    if categories is not None:
        wanted += f" AND category IN ({', '.join(map(quoted, categories))})"
    example = (
        "min_by(named_struct('row_id', row_id, 'question', question,"
        f" 'wrong', {shorten('answer_a', limit, ' [...]')}, 'truth', ground_truth), row_id)"
    )
    first = results.where(wanted).groupBy("category").agg(F.expr(example).alias("example"))
    return first.select("category", "example.*")
