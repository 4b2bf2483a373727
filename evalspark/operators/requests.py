"""Judge requests as a table, ready to be sent in bulk by whatever client is used."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evalspark.functions.text import is_failed, quoted

# The wording a judge model receives.
QUESTION = "Question: "
ANSWER_A = "Answer A: "
ANSWER_B = "Answer B: "
BASELINE = "Baseline Answer: "
ANSWER = "Answer: "
TRUTH = "Ground Truth: "
NO_BASELINE = "(no baseline answer available)"
ASK = {
    "full": "Judge each answer against the ground truth. Return only valid JSON.",
    "agents": "Judge both answers against the ground truth. Return only valid JSON.",
    "baseline": "Is the Answer factually correct according to the ground truth? "
    "Return only valid JSON.",
}


def _part(label: str, text: str) -> str:
    return f"concat('{label}', coalesce({text}, ''))"


def prompt(kind: str) -> str:
    """The judge's prompt: ``full`` (A, B and baseline), ``agents`` or ``baseline``."""
    pair = (_part(ANSWER_A, "answer_a"), _part(ANSWER_B, "answer_b"))
    base = f"CASE WHEN {is_failed('base_answer')} THEN '{NO_BASELINE}' ELSE base_answer END"
    answers = {
        "full": (*pair, _part(BASELINE, base)),
        "agents": pair,
        "baseline": (_part(ANSWER, "base_answer"),),
    }[kind]
    parts = (
        _part(QUESTION, "question"), *answers, _part(TRUTH, "ground_truth"), f"'{ASK[kind]}'"
    )
    return rf"concat_ws('\n\n', {', '.join(parts)})"


def judge_requests(rows: DataFrame, kind: str = "full") -> DataFrame:
    """One prompt per row; a baseline that did not answer has nothing to be graded alone."""
    wanted = rows.where(f"NOT {is_failed('base_answer')}") if kind == "baseline" else rows
    return wanted.selectExpr("row_id", f"'{kind}' AS kind", f"{prompt(kind)} AS prompt")


def request_json(
    requests: DataFrame, model: str, system: str, max_tokens: int = 200,
    temperature: float = 0.3,
) -> DataFrame:
    """The prompts as chat-request JSON lines for the caller's model and instructions."""
    messages = (
        f"array(named_struct('role', 'system', 'content', {quoted(system)}),"
        " named_struct('role', 'user', 'content', prompt))"
    )
    body = (
        f"named_struct('model', {quoted(model)}, 'messages', {messages},"
        f" 'temperature', {temperature}D, 'max_tokens', {max_tokens})"
    )
    return requests.selectExpr("row_id", "kind", f"to_json({body}) AS request")
