"""Is a wrong answer more likely in one group?  Relative risk, odds ratio, chi-square and
Fisher tests on 2x2 counts, for any number of segments at once.

Counts a, b are the rows of the first group with and without the event, c, d those of the
second group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.booleans import is_true
from evalspark.functions.stats import (
    chi_square_p,
    log_weight_change,
    percent,
    ratio,
    yates_chi_square,
)
from evalspark.functions.text import quoted
from evalspark.operators.columns import add
from evalspark.operators.metrics import BOTH_WRONG, VALID, count

# ln of the smallest double, about: a table that is less likely than the most likely one by
# this much has weight 0.0 and adds nothing to any sum.
LEAST_LOG = -745
# Tables considered are generated in runs, so no array grows with the counts.
RUN = 4096


def two_by_two(group: str, event: str) -> dict[str, str]:
    """Conditions for the four counts, from two SQL conditions."""
    return {
        "a": f"{group} AND {event}",
        "b": f"{group} AND NOT {event}",
        "c": f"NOT {group} AND {event}",
        "d": f"NOT {group} AND NOT {event}",
    }


def risk_measures(tables: DataFrame) -> DataFrame:
    """Add relative risk, odds ratio and the Yates chi-square test to 2x2 counts."""
    measured = add(
        tables,
        {
            "relative_risk": f"try_divide({ratio('a', 'a + b')}, {ratio('c', 'c + d')})",
            "odds_ratio": ratio("double(a) * d", "double(b) * c"),
            "chi": yates_chi_square("a", "b", "c", "d"),
        },
    )
    tests = {"chi_square": "round(chi, 6)", "chi_square_p": chi_square_p("chi")}
    return add(measured, tests).drop("chi")


def fisher_exact(tables: DataFrame) -> DataFrame:
    """Add the two-sided Fisher p of each 2x2 table: the share of all tables with the same
    margins that are no more likely than the observed one.

    Weights are relative to about the most likely table and fall on both sides of it, so two
    bisections find where they vanish; only the tables between are listed, about the square
    root of the counts.  A p below the smallest double is 0.0.  Rows of ``tables`` must differ.
    """

    def weight(k: str) -> str:
        cells = ("top", "(r1 - top)", "(c1 - top)", "(n - r1 - c1 + top)")
        return log_weight_change(tuple(f"double{c}" if c[0] == "(" else f"double({c})" for c in cells), f"double({k} - top)")

    def edge(end: str, towards: str) -> str:
        """The last table from the top on that still has weight, by halving the rest."""
        inside = f"({weight('m')} > {LEAST_LOG})"
        middle = "s.inside + (s.outside - s.inside) DIV 2"
        halved = (
            f"get(transform(array({middle}), m -> CASE WHEN abs(s.outside - s.inside) <= 1 THEN s"
            f" WHEN {inside} THEN named_struct('inside', m, 'outside', s.outside)"
            " ELSE named_struct('inside', s.inside, 'outside', m) END), 0)"
        )
        start = f"named_struct('inside', top, 'outside', {end} {towards} 1L)"
        return f"aggregate(sequence(1, 63), {start}, (s, i) -> {halved}, s -> s.inside)"

    margins = add(tables, {"r1": "a + b", "c1": "a + c", "n": "a + b + c + d"})
    ends = add(margins, {"least": "greatest(0L, r1 + c1 - n)", "most": "least(r1, c1)"})
    mode = "bigint(floor((double(r1) + 1) * (double(c1) + 1) / (double(n) + 2)))"
    topped = add(ends, {"top": f"least(most, greatest(least, {mode}))"})
    bounds = add(
        topped,
        {"low": edge("least", "-"), "high": edge("most", "+"), "at_observed": weight("a")},
    )
    starts = add(bounds, {"start": f"explode(sequence(low, high, {RUN}L))"})
    possible = add(starts, {"k": f"explode(sequence(start, least(start + {RUN - 1}, high)))"})
    weighed = add(add(possible, {"own": weight("k")}), {"weight": "exp(own)"})
    unlikely = "CASE WHEN own <= at_observed + 1e-7D THEN weight ELSE 0.0D END"
    return weighed.groupBy(*tables.columns).agg(
        F.expr(f"sum({unlikely}) / sum(weight)").alias("fisher_p")
    )


def risk_association(results: DataFrame, segment: str = "category") -> DataFrame:
    """Disagreement against both-wrong per segment and over all (segment ``ALL``), with the
    relative risk of an ensemble error beside it.  Unknown flags: agree, wrong."""
    apart, lost = is_true("semantic_disagreement"), f"NOT {is_true('ensemble_correct')}"
    conditions = two_by_two(apart, BOTH_WRONG) | {
        "lost_apart": f"{apart} AND {lost}",
        "lost_together": f"NOT {apart} AND {lost}",
    }
    named = f"CASE WHEN grouping({segment}) = 1 THEN 'ALL' ELSE coalesce({segment}, '(none)') END"
    counts = (
        results.where(VALID)
        .rollup(segment)
        .agg(
            F.expr(named).alias("segment"),
            *(F.expr(f"count_if({sql})").alias(name) for name, sql in conditions.items()),
        )
        .drop(segment)
    )
    lost_risk = (
        f"try_divide({ratio('lost_apart', 'a + b')}, {ratio('lost_together', 'c + d')})"
    )
    tested = add(risk_measures(fisher_exact(counts)), {"ensemble_relative_risk": lost_risk})
    return tested.drop("lost_apart", "lost_together")


def bucket_association(results: DataFrame, listed: Sequence[str]) -> DataFrame:
    """Consensus and divergent error rates in listed categories against all others, with
    the chi-square and Fisher tests on consensus errors (on both rows alike)."""
    inside = f"coalesce(category IN ({', '.join(map(quoted, listed))}), false)"
    apart = is_true("semantic_disagreement")
    conditions = two_by_two(inside, f"({BOTH_WRONG} AND NOT {apart})") | {
        "divergent_in": f"{inside} AND {BOTH_WRONG} AND {apart}",
        "divergent_out": f"NOT {inside} AND {BOTH_WRONG} AND {apart}",
    }
    tested = risk_measures(fisher_exact(count(results.where(VALID), conditions)))
    sides = tested.selectExpr(
        "stack(2, 'listed', a + b, a, divergent_in, 'other', c + d, c, divergent_out)"
        " AS (bucket, n, consensus, divergent)",
        "chi_square_p", "fisher_p",
    )
    return add(
        sides,
        {
            "consensus_pct": percent("consensus", "n"),
            "divergent_pct": percent("divergent", "n"),
        },
    )
