"""From raw model replies to the result table.

Every step is a projection of the row, so the whole chain runs in the scan stage without
a shuffle, and runs unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from evalspark.functions import verdict as V
from evalspark.functions.similarity import TextSimilarity, text_cosine
from evalspark.functions.text import clean_output, is_attempted, is_error, is_failed
from evalspark.operators.columns import add, settle
from evalspark.sources import schema as S

Similarity = Callable[[str, str], str]
"""Two column names to a SQL expression; ``text_cosine``, or a vector cosine for users
who bring embedding columns."""

# Texts that are compared with each other; the baseline on its own, as few metrics need it.
AGENTS = ("answer_a", "answer_b", "ground_truth")
BASELINE = ("base_answer", "ground_truth")

PAIR_FAILED = f"({is_failed('answer_a')} OR {is_failed('answer_b')})"


def clean_replies(rows: DataFrame) -> DataFrame:
    """Answers from raw replies ``reply_a``, ``reply_b``, ``reply_base``.

    The pair is settled, as most metrics filter on it; the baseline stays a plain column, so
    that its text is not even read where nothing asks for it.
    """
    pair = {"answer_a": clean_output("reply_a"), "answer_b": clean_output("reply_b")}
    answers = add(settle(rows, pair), {"base_answer": clean_output("reply_base")})
    return answers.drop("reply_a", "reply_b", "reply_base")


def pair_similarity(
    rows: DataFrame,
    similar: Similarity | None = None,
    threshold: float = S.SIMILARITY_THRESHOLD,
) -> DataFrame:
    """Add the A-to-B similarity (6 decimals) and the disagreement flag.

    A failed pair has similarity 0.0 and counts as no disagreement.  The flag looks at the
    unrounded value.
    """
    used = ["exact_similarity"]
    if similar is None:
        similar = TextSimilarity()
        rows = similar.compared(rows, AGENTS[:2])
        used.append(similar(*AGENTS[:2]))
    exact = f"CASE WHEN {PAIR_FAILED} THEN 0.0D ELSE {similar('answer_a', 'answer_b')} END"
    flags = {
        "similarity": "round(exact_similarity, 6)",
        "semantic_disagreement": f"NOT {PAIR_FAILED} AND exact_similarity < {threshold}D",
    }
    return add(add(rows, {"exact_similarity": exact}), flags).drop(*used)


def parse_verdicts(rows: DataFrame, truthy: bool = False) -> DataFrame:
    """Add what the judge's reply says: ``parsed`` and the ``said_*`` columns.

    ``parsed`` is true only if both flags, the status and the selection can be read.
    """
    fields = {
        "a": "answer_a_correct", "b": "answer_b_correct", "base": "baseline_correct",
        "status": "selection_status", "selected": "selected_answer", "reason": "reason",
    }
    found = settle(rows, {"object": V.parse_object(V.json_object("verdict"))})
    typed = settle(
        found,
        {f"kind_{name}": V.kind("object", key) for name, key in fields.items()}
        | {f"text_{name}": V.text("object", key) for name, key in fields.items()},
    ).drop("object")
    said = settle(
        typed,
        {f"said_{x}": V.flag(f"kind_{x}", f"text_{x}", truthy) for x in ("a", "b")}
        | {
            f"said_{x}": V.enum(f"kind_{x}", f"text_{x}", truthy)
            for x in ("status", "selected")
        }
        | {
            "said_reason": "coalesce(text_reason, '')",
            "said_base": f"coalesce({V.flag('kind_base', 'text_base', truthy)}, false)",
        },
    )
    readable = "said_a IS NOT NULL AND said_b IS NOT NULL AND said_status IS NOT NULL AND said_selected IS NOT NULL"
    used = [f"{part}_{name}" for part in ("kind", "text") for name in fields]
    return add(said.drop(*used), {"parsed": readable})


def status_of(a: str, b: str) -> str:
    """The four-way status two correctness flags stand for; names each flag once."""
    words = f"array('{S.BOTH_WRONG}', '{S.B_CORRECT}', '{S.A_CORRECT}', '{S.BOTH_CORRECT}')"
    return f"get({words}, 2 * int({a}) + int({b}))"


def selection_of(status: str) -> str:
    """The selection that goes with a four-way status."""
    cases = " ".join(f"WHEN '{word}' THEN '{s}'" for word, s in S.SELECTION_OF.items())
    return f"CASE {status} {cases} END"


def base_grade(
    similar: Similarity = text_cosine, threshold: float = S.SIMILARITY_THRESHOLD
) -> str:
    """Baseline correctness by similarity alone: pending is NULL, failed is false."""
    near = f"{similar('base_answer', 'ground_truth')} > {threshold}D"
    return (
        f"CASE WHEN NOT {is_attempted('base_answer')} THEN NULL"
        f" WHEN {is_failed('base_answer')} THEN false ELSE {near} END"
    )


def resolve_verdicts(
    rows: DataFrame,
    similar: Similarity = text_cosine,
    threshold: float = S.SIMILARITY_THRESHOLD,
) -> DataFrame:
    """Turn parsed verdicts into result columns, with a fallback for unreadable ones.

    A failed pair or a failed judge call becomes an error row.  Otherwise an unreadable
    verdict is replaced by similarity to the ground truth, computed only where needed.
    """

    def graded(said: str, answer: str) -> str:
        near = f"{similar(answer, 'ground_truth')} > {threshold}D"
        return f"CASE WHEN judge_failed THEN false WHEN parsed THEN {said} ELSE {near} END"

    call_failed = f"(verdict IS NULL OR {is_error('verdict')})"
    attempted = is_attempted("base_answer")
    said_base = f"said_base AND NOT {is_failed('base_answer')}"
    failed = add(
        rows, {"pair_failed": PAIR_FAILED, "judge_failed": f"{PAIR_FAILED} OR {call_failed}"}
    )
    flags = add(
        failed,
        {"a_correct": graded("said_a", "answer_a"), "b_correct": graded("said_b", "answer_b")},
    )
    worded = add(
        flags,
        {
            "base_correct": base_grade(similar, threshold),
            "factual_disagreement": "a_correct <> b_correct",
            "status": f"CASE WHEN judge_failed THEN '{S.JUDGE_ERROR}' WHEN parsed"
            f" THEN said_status ELSE {status_of('a_correct', 'b_correct')} END",
            "reason": f"CASE WHEN pair_failed THEN '{S.SKIPPED_REASON}' WHEN judge_failed"
            f" THEN coalesce(verdict, 'ERROR:') WHEN parsed THEN said_reason"
            f" ELSE '{S.FALLBACK_REASON}' END",
        },
    )
    return add(
        worded,
        {
            "base_judged": f"CASE WHEN {attempted} AND parsed AND NOT judge_failed"
            f" THEN {said_base} ELSE base_correct END",
            "selected": "CASE WHEN judge_failed THEN 'NONE' WHEN parsed THEN said_selected"
            f" ELSE {selection_of('status')} END",
            "final_answer": f"CASE status WHEN '{S.A_CORRECT}' THEN answer_a"
            f" WHEN '{S.B_CORRECT}' THEN answer_b WHEN '{S.BOTH_CORRECT}'"
            f" THEN '{S.BOTH_CORRECT}' ELSE '{S.NO_ANSWER}' END",
            "ensemble_correct": f"status IN ('{S.A_CORRECT}', '{S.B_CORRECT}',"
            f" '{S.BOTH_CORRECT}')",
        },
    )


def grade_baseline(
    rows: DataFrame,
    similar: Similarity | None = None,
    threshold: float = S.SIMILARITY_THRESHOLD,
    truthy: bool = False,
) -> DataFrame:
    """Grade late baseline answers: ``base_correct`` by similarity, ``base_judged`` by the
    baseline-only judge's reply in ``verdict``, or by similarity if that is unreadable."""
    key = "answer_correct"
    used = ["object", "said_kind", "said_text"]
    found = settle(rows, {"object": V.parse_object(V.json_object("verdict"))})
    typed = settle(
        found, {"said_kind": V.kind("object", key), "said_text": V.text("object", key)}
    )
    if similar is None:
        similar = TextSimilarity()
        typed = similar.compared(typed, BASELINE)
        used.append(similar(*BASELINE))
    graded = add(typed, {"base_correct": base_grade(similar, threshold)})
    judged = (
        f"CASE WHEN {is_failed('base_answer')} THEN base_correct"
        f" ELSE coalesce({V.flag('said_kind', 'said_text', truthy)}, base_correct) END"
    )
    return add(graded, {"base_judged": judged}).drop(*used)


def evaluate(
    rows: DataFrame,
    similar: Similarity | None = None,
    threshold: float = S.SIMILARITY_THRESHOLD,
    truthy: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The whole chain: raw replies and verdicts to the result table.

    ``rows`` has row_id, question, ground_truth, reply_a, reply_b, reply_base (NULL where
    the baseline is left for later) and verdict; ``keep`` names columns to carry along.
    Without ``similar`` texts are compared by their words, a batch of rows at a time.
    """
    parsed = parse_verdicts(clean_replies(rows), truthy)
    if similar is None:
        similar = TextSimilarity()
        parsed = similar.compared(parsed, AGENTS, BASELINE)
    resolved = resolve_verdicts(parsed, similar, threshold)
    return pair_similarity(resolved, similar, threshold).select(
        "row_id", *S.RESULT_COLUMNS, *keep
    )
