"""Metrics of a run that is still going on, from one row of counts a batch.

A batch is counted once, as it comes; metrics of any number of batches are sums of their rows, so nothing
is read again.  A batch that is repeated after a failure replaces its own row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.columns import add
from evalspark.operators.groups import APART, WRONG, groups_of
from evalspark.operators.metrics import (
    AGAINST_BASE,
    OPERATIONS,
    QUALITY,
    SUMMARY,
    VALID,
    base_of,
    count,
    operations_of,
    summary_of,
)

_OF_GROUP = {"agree": f"NOT {APART}", "disagree": APART}


def _within(prefix: str, conditions: Mapping[str, str], scope: str = "true") -> dict[str, str]:
    return {f"{prefix}_{name}": f"({scope}) AND ({sql})" for name, sql in conditions.items()}


COUNTS = (
    _within("summary", SUMMARY)
    | _within("base", AGAINST_BASE, "is_valid")
    | _within("quality", QUALITY)
    | _within("operations", OPERATIONS)
    | {
        name: sql
        for group, scope in _OF_GROUP.items()
        for name, sql in _within(group, WRONG, f"is_valid AND {scope}").items()
    }
)
STATE = "batch string, " + ", ".join(f"{name} long" for name in COUNTS)


def state_of(results: DataFrame, batch: str) -> DataFrame:
    """One row: the batch and all its counts, from one pass."""
    counted = count(add(results, {"is_valid": VALID}), COUNTS)
    return counted.select(F.lit(batch).alias("batch"), *COUNTS)


def _sums(states: DataFrame, prefix: str, conditions: Mapping[str, str]) -> DataFrame:
    """The counts of all batches; zeros without any."""
    return states.agg(*(F.coalesce(F.sum(f"{prefix}_{name}"), F.lit(0)).alias(name) for name in conditions))


def eval_summary(states: DataFrame) -> DataFrame:
    return summary_of(_sums(states, "summary", SUMMARY))


def base_metrics(states: DataFrame) -> DataFrame:
    return base_of(_sums(states, "base", AGAINST_BASE))


def data_quality(states: DataFrame) -> DataFrame:
    return _sums(states, "quality", QUALITY)


def operational_rates(states: DataFrame) -> DataFrame:
    return operations_of(_sums(states, "operations", OPERATIONS))


def disagreement_groups(states: DataFrame) -> DataFrame:
    """Agreeing rows, disagreeing rows, and all; those of which there are any."""
    each = {group: {name: f"{group}_{name}" for name in WRONG} for group in _OF_GROUP}
    each["all"] = {name: " + ".join(f"{group}_{name}" for group in _OF_GROUP) for name in WRONG}
    total = states.agg(*(F.coalesce(F.sum(f"{g}_{n}"), F.lit(0)).alias(f"{g}_{n}") for g in _OF_GROUP for n in WRONG))
    cells = ", ".join(f"'{group}', {', '.join(sql.values())}" for group, sql in each.items())
    rows = total.selectExpr(f"stack({len(each)}, {cells}) AS (grp, {', '.join(WRONG)})")
    return groups_of(rows.where("n > 0"))
