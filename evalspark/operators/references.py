"""An independent rater: is an answer closer to the correct or to the incorrect references?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.booleans import is_true
from evalspark.functions.bags import nearest, plain
from evalspark.functions.similarity import best_cosine
from evalspark.functions.text import is_attempted, is_failed
from evalspark.operators.columns import add
from evalspark.operators.joins import lookup


@dataclass(frozen=True)
class Rated:
    """One answer column with the judge's flag for it."""

    who: str
    answer: str
    judge: str

    @property
    def label(self) -> str:
        return f"ref_{self.who}"


RATED = (
    Rated("agentA", "answer_a", "a_correct"),
    Rated("agentB", "answer_b", "b_correct"),
    Rated("baseline", "base_answer", "base_judged"),
)

BOTH_SETS = "coalesce(size(correct) > 0 AND size(incorrect) > 0, false)"


def _both_sets(references: DataFrame) -> DataFrame:
    """Per question all its reference texts, the ``n_correct`` correct ones first; questions
    without both sets go."""
    return references.where(BOTH_SETS).selectExpr(
        "question", "size(correct) AS n_correct", "concat(correct, incorrect) AS texts"
    )


def reference_labels(
    results: DataFrame,
    references: DataFrame,
    keep: Sequence[str] = (),
    rated: Sequence[Rated] = RATED,
    rows_per_task: int | None = None,
    questions: DataFrame | None = None,
) -> DataFrame:
    """Per row and answer column: closer (by words) to a correct than to an incorrect one?

    ``references`` has one row per question with arrays ``correct`` and ``incorrect``.
    A label is NULL for an answer that failed or where either set is missing or empty.
    ``keep`` names small columns to carry along; ``rows_per_task`` and ``questions`` are
    those of ``lookup``.

    References are shuffled to their question; answers are shuffled once, to the same place, and
    compared there, a batch of rows at a time.
    """
    rows = lookup(
        results.select("row_id", "question", *keep, *(r.answer for r in rated)),
        _both_sets(references.repartition("question")),
        "question", "left", rows_per_task, questions,
    )
    labels = {
        r.label: f"CASE WHEN {_usable(r)} THEN get(near, {2 * i}) > get(near, {2 * i + 1}) END"
        for i, r in enumerate(rated)
    }
    return add(_met(rows, rated), labels).select("row_id", *keep, *labels)


def _usable(r: Rated) -> str:
    return f"n_correct IS NOT NULL AND NOT {is_failed(r.answer)} AND {is_attempted(r.answer)}"


def _met(rows: DataFrame, rated: Sequence[Rated]) -> DataFrame:
    """Add ``near``: how near the nearest correct and the nearest incorrect text is, for each answer.

    An answer's own norm divides both sides alike, so it is left out.  Answers that are not
    usable have no words.
    """
    said = [f"CASE WHEN {_usable(r)} THEN {plain(r.answer)} END" for r in rated]
    texts = f"transform(texts, t -> {plain('t')})"
    return rows.withColumn("near", nearest(said, texts, "n_correct"))


def reference_texts(references: DataFrame) -> DataFrame:
    """One row a reference text, ``question, text, is_correct``, from rows with both arrays."""
    sides = [
        references.selectExpr("question", f"explode({side}) AS text", f"{side == 'correct'} AS is_correct")
        for side in ("correct", "incorrect")
    ]
    return sides[0].unionByName(sides[1])


def sharded_reference_labels(
    results: DataFrame,
    texts: DataFrame,
    keep: Sequence[str] = (),
    rated: Sequence[Rated] = RATED,
    chars_per_shard: int = 1 << 20,
    rows_per_task: int | None = None,
) -> DataFrame:
    """The labels of ``reference_labels`` for reference sets of any size.

    ``texts`` has one row a reference text (``question, text, is_correct``).  The texts of a
    question are dealt by hash into shards of about ``chars_per_shard`` characters, each indexed
    in a row of its own; equal texts count once, as they are equally close.  An answer meets every
    shard of its question, and the nearest text of each side is a maximum over its shards, which
    Spark takes in part before it shuffles.
    """
    known = texts.where("text IS NOT NULL").select("question", "text", "is_correct").distinct()
    sizes = known.groupBy("question").agg(
        F.expr(f"int(ceil((sum(length(text)) + 1) / {chars_per_shard}))").alias("shards"),
        F.expr("count_if(is_correct) > 0 AND count_if(NOT is_correct) > 0").alias("both"),
    )
    sizes = sizes.where("both").drop("both")
    dealt = add(known.join(sizes, "question"), {
        "place": "struct(question, int(pmod(xxhash64(text), shards)) AS shard)"
    })
    sets = dealt.groupBy("place").agg(
        F.expr("collect_list(CASE WHEN is_correct THEN text END)").alias("correct"),
        F.expr("collect_list(CASE WHEN NOT is_correct THEN text END)").alias("incorrect"),
    )
    shards = sets.selectExpr("place", "size(correct) AS n_correct", "concat(correct, incorrect) AS texts")

    answers = results.select("row_id", "question", *keep, *(r.answer for r in rated))
    answers = lookup(answers, sizes, "question", "left", rows_per_task)
    answers = answers.withColumn("shard", F.expr("explode_outer(sequence(0, shards - 1))"))
    answers = add(answers, {"place": "struct(question, shard)"}).drop("question", "shards", "shard")
    met = lookup(answers, shards, "place", "left", rows_per_task)
    found = _met(met, rated)
    nearest = {
        f"{side}_{i}": f"max(CASE WHEN {_usable(r)} THEN get(near, {2 * i + wrong}) END)"
        for i, r in enumerate(rated)
        for wrong, side in enumerate(("right", "wrong"))
    }
    best = found.groupBy("row_id", *keep).agg(*(F.expr(sql).alias(name) for name, sql in nearest.items()))
    labels = {r.label: f"right_{i} > wrong_{i}" for i, r in enumerate(rated)}
    return add(best, labels).select("row_id", *keep, *labels)


def reference_labels_by_vector(
    rows: DataFrame, references: DataFrame, key: str = "question",
    rows_per_task: int | None = None,
) -> DataFrame:
    """The same rule on vectors: ``rows`` has ``vector``, ``references`` arrays of vectors.

    Rows without both sets are dropped.
    """
    closer = f"{best_cosine('vector', 'correct')} > {best_cosine('vector', 'incorrect')}"
    joined = lookup(rows, references, key, "inner", rows_per_task)
    rated = joined.where(f"{BOTH_SETS} AND vector IS NOT NULL")
    return add(rated, {"ref": closer}).drop("vector", "correct", "incorrect")


def rater_long(labels: DataFrame, rated: Sequence[Rated] = RATED) -> DataFrame:
    """One row per judgment: ``row_id, who, judge, ref``; unlabelled answers are dropped.

    ``labels`` is the output of ``reference_labels`` that kept the judge's flags.
    """
    judgments = ", ".join(
        f"named_struct('who', '{r.who}', 'judge', {is_true(r.judge)}, 'ref', {r.label})"
        for r in rated
    )
    return labels.selectExpr("row_id", f"inline(array({judgments}))").where("ref IS NOT NULL")


def raters_disagree(rated: Sequence[Rated] = RATED) -> str:
    """True where judge and reference rater differ on any labelled answer of the row."""
    return "(" + " OR ".join(
        f"coalesce({is_true(r.judge)} <> {r.label}, false)" for r in rated
    ) + ")"
