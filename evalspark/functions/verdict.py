"""Typed fields out of the free text a judge model returns."""

from __future__ import annotations

from evalspark.functions.booleans import tri_state
from evalspark.functions.text import clean_output

NUMBER = r"r'^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(.*\))$'"
NESTED = "'^(ARRAY|OBJECT)'"


def json_object(reply: str) -> str:
    """The text from the first ``{`` to the last ``}`` of a cleaned reply, or NULL."""
    return rf"nullif(regexp_extract({clean_output(reply)}, r'(?s)\{{.*\}}', 0), '')"


def parse_object(span: str) -> str:
    """VARIANT of one JSON object, NULL when the text is anything but exactly one.

    The parser stops at the end of the first value, so ``{..} {..}`` would pass.  What
    could follow the object and still close an array cannot also close an object, and the
    reverse, so text that parses inside both wrappers has nothing behind it.
    """
    in_array = f"try_parse_json(concat('[', {span}, ']'))"
    in_object = f"""try_parse_json(concat('{{"v":', {span}, '}}'))"""
    value = f"try_variant_get({in_array}, '$[0]', 'variant')"
    return f"CASE WHEN {in_object} IS NOT NULL THEN {value} END"


def kind(verdict: str, key: str) -> str:
    """Type name of a field: VOID for an explicit null, NULL for a missing key."""
    return f"schema_of_variant(try_variant_get({verdict}, '$.{key}', 'variant'))"


def text(verdict: str, key: str) -> str:
    return f"try_variant_get({verdict}, '$.{key}', 'string')"


def flag(kind: str, text: str, truthy: bool = False) -> str:
    """A correctness flag from a field's type name and text; NULL when it cannot be read
    and the fallback must decide.

    By default a value means what it says: ``"false"`` is false, a number is compared with
    0, an explicit null is false, other types are unreadable.  With ``truthy`` every value
    that is not empty, zero or null counts as true, as a truth test on parsed JSON does.
    """
    if truthy:
        others = (
            f"WHEN {kind} = 'STRING' THEN {text} <> ''"
            f" WHEN {kind} RLIKE {NESTED} THEN {text} NOT IN ('[]', '{{}}')"
        )
    else:
        others = f"WHEN {kind} = 'STRING' THEN {tri_state(text)}"
    return (
        f"CASE WHEN {kind} = 'BOOLEAN' THEN {text} = 'true' WHEN {kind} = 'VOID' THEN false"
        f" WHEN {kind} RLIKE {NUMBER} THEN try_cast({text} AS DOUBLE) <> 0 {others} END"
    )


def enum(kind: str, text: str, truthy: bool = False) -> str:
    """An upper-cased word; NULL when missing, null or nested (``truthy``: null is NONE)."""
    null = f"WHEN {kind} = 'VOID' THEN 'NONE'" if truthy else ""
    return (
        f"CASE WHEN {kind} IN ('STRING', 'BOOLEAN') OR {kind} RLIKE {NUMBER}"
        f" THEN upper({text}) {null} END"
    )
