"""Tables expanded from published counts must give the published ratios."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from evalspark.operators import association, groups, reliability

# Published cell counts.
DISAGREE_BOTH_WRONG, DISAGREE_OTHER = 114, 275
AGREE_BOTH_WRONG, AGREE_OTHER = 128, 300
AGENTS = {(True, True): 638, (True, False): 240, (False, True): 375, (False, False): 381}
BASELINE = {(True, True): 327, (True, False): 132, (False, True): 188, (False, False): 170}


def expand(spark, rows, columns):
    """Repeat each row by its last field."""
    frame = spark.createDataFrame(rows, [*columns, "times"])
    return frame.withColumn("i", F.expr("explode(sequence(1, times))")).drop("times", "i")


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        (True, "BOTH_WRONG", False, DISAGREE_BOTH_WRONG),
        (True, "BOTH_CORRECT", True, DISAGREE_OTHER),
        (False, "BOTH_WRONG", False, AGREE_BOTH_WRONG),
        (False, "A_CORRECT", True, AGREE_OTHER),
    ]
    frame = expand(spark, rows, ["semantic_disagreement", "status", "ensemble_correct"])
    return frame.selectExpr(
        "*", "'x' AS answer_a", "'y' AS answer_b", "'c' AS category",
        "status IN ('BOTH_CORRECT', 'A_CORRECT') AS a_correct",
        "status = 'BOTH_CORRECT' AS b_correct",
    )


def test_disagreement_does_not_predict_errors(results):
    rows = {r["segment"]: r for r in association.risk_association(results).collect()}
    all_rows = rows["ALL"]
    assert (all_rows["a"], all_rows["b"], all_rows["c"], all_rows["d"]) == (114, 275, 128, 300)
    assert round(all_rows["relative_risk"], 2) == 0.98
    assert round(all_rows["ensemble_relative_risk"], 2) == 0.98
    assert round(all_rows["odds_ratio"], 2) == 0.97
    assert round(all_rows["chi_square_p"], 2) == 0.91
    assert round(all_rows["fisher_p"], 2) == 0.88
    assert rows["c"]["fisher_p"] == all_rows["fisher_p"]


def test_groups_and_split(results):
    rows = {r["grp"]: r for r in groups.disagreement_groups(results).collect()}
    assert round(rows["disagree"]["both_wrong_pct"], 1) == 29.3
    assert round(rows["agree"]["both_wrong_pct"], 1) == 29.9
    assert round(rows["all"]["both_wrong_pct"], 1) == 29.6
    assert rows["all"]["n"] == rows["agree"]["n"] + rows["disagree"]["n"] == 817
    split = groups.consensus_split(results).first()
    assert (split["consensus"], split["divergent"], split["both_wrong"]) == (128, 114, 242)


def test_buckets(spark):
    rows = [
        ("myth", False, "BOTH_WRONG", 50), ("myth", True, "BOTH_WRONG", 22),
        ("myth", False, "A_CORRECT", 229 - 72),
        ("fact", False, "BOTH_WRONG", 78), ("fact", True, "BOTH_WRONG", 92),
        ("fact", False, "A_CORRECT", 588 - 170),
    ]
    frame = expand(spark, rows, ["category", "semantic_disagreement", "status"]).selectExpr(
        "*", "'x' AS answer_a", "'y' AS answer_b"
    )
    found = {r["bucket"]: r for r in association.bucket_association(frame, ["myth"]).collect()}
    assert round(found["listed"]["consensus_pct"], 1) == 21.8
    assert round(found["other"]["consensus_pct"], 1) == 13.3
    assert (found["listed"]["n"], found["listed"]["divergent"]) == (229, 22)
    assert round(found["listed"]["chi_square_p"], 4) == 0.0035


def test_rater_agreement(spark):
    rows = [("agentA", *cell, n) for cell, n in AGENTS.items()]
    rows += [("baseline", *cell, n) for cell, n in BASELINE.items()]
    frame = expand(spark, rows, ["who", "ref", "judge"])
    found = {r["grp"]: r for r in reliability.rater_agreement(frame).collect()}
    shown = {
        grp: (r["n"], round(r["agree_pct"], 1), round(r["kappa"], 3), r["cm"])
        for grp, r in found.items()
    }
    assert shown == {
        "agents": (1634, 62.4, 0.234, [[638, 240], [375, 381]]),
        "baseline": (817, 60.8, 0.191, [[327, 132], [188, 170]]),
        "overall": (2451, 61.9, 0.22, [[965, 372], [563, 551]]),
    }


def test_one_label_has_no_kappa(spark):
    frame = spark.createDataFrame(
        [("agentA", True, True), ("agentA", True, False)], ["who", "ref", "judge"]
    )
    assert {r["kappa"] for r in reliability.rater_agreement(frame).collect()} == {None}


def test_category_order(spark):
    counts = [("History", 24, 23), ("Time", 16, 16), ("Language", 21, 11), ("Few", 9, 9)]
    rows = [(c, True, good) for c, _, good in counts]
    rows += [(c, False, n - good) for c, n, good in counts if n > good]
    frame = expand(spark, rows, ["category", "ensemble_correct"]).selectExpr(
        "*", "'x' AS answer_a", "'y' AS answer_b"
    )
    found = groups.category_rank(frame, k=2).collect()
    best = [(r["category"], round(r["rate"], 1)) for r in found if r["end"] == "best"]
    worst = [(r["category"], round(r["rate"], 1)) for r in found if r["end"] == "worst"]
    assert best == [("Time", 100.0), ("History", 95.8)]
    assert worst == [("Language", 52.4), ("History", 95.8)]


def exact_fisher(a, b, c, d):
    """By whole numbers; only for narrow margins."""
    r, k, n = a + b, a + c, a + b + c + d
    weight = {i: math.comb(r, i) * math.comb(n - r, k - i) for i in range(max(0, r + k - n), min(r, k) + 1)}
    return float(Fraction(sum(w for w in weight.values() if w <= weight[a]), sum(weight.values())))


def test_fisher_of_skewed_and_huge_tables(spark):
    cases = [
        (3, 97, 2, 10**7), (0, 5, 3, 10**9), (7, 10**9, 40, 10**9), (1, 10**12, 9, 10**12), (2, 3 * 10**9, 60, 10**10),
        (12, 5, 3, 400), (0, 1, 1, 0), (20, 10**6, 0, 10**6), (5, 10**11, 30, 10**9), (30, 2, 1, 30),
    ]
    tables = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cases)], "segment string, a long, b long, c long, d long")
    found = {int(r["segment"]): r["fisher_p"] for r in association.fisher_exact(tables).collect()}
    for i, case in enumerate(cases):
        assert found[i] == pytest.approx(exact_fisher(*case), rel=1e-6), case


def test_fisher_of_wide_huge_tables(spark):
    tables = spark.createDataFrame(
        [("near", 250_000_000, 250_020_000, 249_990_000, 250_000_000), ("same", 10**9, 10**9, 10**9, 10**9)],
        "segment string, a long, b long, c long, d long",
    )
    found = {r["segment"]: r for r in association.risk_measures(association.fisher_exact(tables)).collect()}
    assert found["near"]["fisher_p"] == pytest.approx(found["near"]["chi_square_p"], rel=1e-3)
    assert found["same"]["fisher_p"] == pytest.approx(1.0)


def test_fisher_of_large_and_empty_tables(spark):
    tables = spark.createDataFrame(
        [("big", 500_000, 500_300, 499_000, 500_000), ("empty", 0, 0, 0, 0),
         ("margin", 0, 5, 0, 7), ("far", 900, 0, 0, 900), ("tiny", 3, 1, 1, 3)],
        "segment string, a long, b long, c long, d long",
    )
    tested = association.risk_measures(association.fisher_exact(tables))
    found = {r["segment"]: r for r in tested.collect()}
    assert found["empty"]["fisher_p"] == found["margin"]["fisher_p"] == 1.0
    assert found["empty"]["chi_square_p"] is None
    assert found["far"]["fisher_p"] == 0.0  # about 1e-540
    assert round(found["tiny"]["fisher_p"], 4) == 0.4857
    assert abs(found["big"]["fisher_p"] - found["big"]["chi_square_p"]) < 0.002
