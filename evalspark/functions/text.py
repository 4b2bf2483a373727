"""Clean-up and predicates for answer text."""

from __future__ import annotations

# Markers a model or a failed call leaves in the text.
ERROR_PREFIX = "ERROR:"
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"

# Whitespace as Python's str.strip sees it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(text: str) -> str:
    """Drop leading and trailing whitespace of any kind (plain ``trim`` drops spaces)."""
    return f"trim(BOTH {quoted(WHITESPACE)} FROM {text})"


def clean_output(text: str) -> str:
    """Remove the reasoning a model puts before its answer.

    Complete think blocks go first; if a closing tag is left, everything up to the first
    one goes too.  An opening tag that is never closed stays where it is.
    """
    without_blocks = f"regexp_replace({text}, '(?s)<think>.*?</think>', '')"
    answer = f"regexp_replace({without_blocks}, '(?s)^.*?</think>', '')"
    # Both steps need a closing tag; most text has none and is not scanned by a pattern.
    return strip(f"CASE WHEN contains({text}, '{THINK_CLOSE}') THEN {answer} ELSE {text} END")


def is_truncated(cleaned: str) -> str:
    """True for cleaned text that is reasoning cut off before any answer."""
    return f"startswith({cleaned}, '{THINK_OPEN}')"


def is_error(answer: str) -> str:
    return f"coalesce(startswith({answer}, '{ERROR_PREFIX}'), false)"


def _first_part(text: str) -> str:
    """Text without leading whitespace: stops at the first character that is none."""
    return f"trim(LEADING {quoted(WHITESPACE)} FROM {text})"


def is_failed(answer: str) -> str:
    """True when there is no usable answer: null, blank, or an error message."""
    blank = f"{_first_part(answer)} = ''"
    return f"coalesce(startswith({answer}, '{ERROR_PREFIX}') OR {blank}, true)"


def is_attempted(answer: str) -> str:
    """True when the deferred baseline has been run: not null, blank or a literal ``nan``."""
    start = f"lower(left({_first_part(answer)}, 3))"
    return (
        f"coalesce({answer} IS NOT NULL AND CASE {start} WHEN '' THEN false"
        f" WHEN 'nan' THEN lower({strip(answer)}) <> 'nan' ELSE true END, false)"
    )


def shorten(text: str, limit: int, mark: str = "...") -> str:
    """Text on one line, cut at ``limit`` characters with ``mark`` behind a cut."""
    line = rf"replace(coalesce({text}, 'nan'), '\n', ' ')"
    cut = f"CASE WHEN length({line}) > {limit} THEN '{mark}' ELSE '' END"
    return f"concat(substring({line}, 1, {limit}), {cut})"


def words(text: str) -> str:
    """Lower-cased runs of letters and digits, in order, as an array."""
    parts = rf"split(lower(coalesce({text}, '')), r'[^\p{{L}}\p{{N}}]+')"
    return f"array_remove({parts}, '')"
