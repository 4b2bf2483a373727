"""Booleans that arrive as text."""

from __future__ import annotations

from evalspark.functions.text import strip


def tri_state(text: str) -> str:
    """true / false / NULL: anything that is neither word is unknown."""
    return f"CASE lower({strip(text)}) WHEN 'true' THEN true WHEN 'false' THEN false END"


def two_state(text: str) -> str:
    """true / false: anything that is not the word true is false."""
    return f"coalesce(lower({strip(text)}) = 'true', false)"


def is_true(flag: str) -> str:
    """A nullable boolean read as two-state."""
    return f"coalesce({flag}, false)"
