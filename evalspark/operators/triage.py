"""What kind of failure is an error message?"""

from __future__ import annotations

from pyspark.sql import DataFrame

from evalspark.operators.columns import add
from evalspark.operators.metrics import count

# What quota and passing errors say.
QUOTA_PHRASES = ("tokens per day",)
QUOTA_WORD = r"\btpd\b"
QUOTA_LETTERS = "tpd"
TRANSIENT_PHRASES = (
    "rate_limit", "rate limit", "429", "500", "502", "503",
    "timeout", "timed out", "connection", "temporarily unavailable",
)


def _mentions(text: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def error_class(message: str, whole_word: bool = True) -> str:
    """``ok`` (no message), ``quota`` (stop the run), ``transient`` (try again), ``other``.

    With ``whole_word`` the abbreviation tpd must stand alone, so that ``httpd`` is no
    quota error; without, any occurrence of the letters counts.
    """
    text = f"lower({message})"
    short = f"{text} RLIKE r'{QUOTA_WORD}'" if whole_word else _mentions(text, (QUOTA_LETTERS,))
    return (
        f"CASE WHEN {message} IS NULL THEN 'ok'"
        f" WHEN {_mentions(text, QUOTA_PHRASES)} OR {short} THEN 'quota'"
        f" WHEN {_mentions(text, TRANSIENT_PHRASES)} THEN 'transient' ELSE 'other' END"
    )


def error_triage(calls: DataFrame, whole_word: bool = True) -> DataFrame:
    """Calls by class of their ``message``."""
    classed = add(calls, {"error_class": error_class("message", whole_word)})
    return count(classed, {"n": "true"}, "error_class")
