"""Cosine similarity of two texts or two vectors that sit in the same row.

No shuffle and no self join: ``text_cosine`` and ``vector_cosine`` are expressions over one row,
which can stand inside a CASE (and only run for the rows that reach it); ``TextSimilarity`` adds
columns computed a batch at a time, which costs far less for long texts.  All are dropped when
nobody reads the column, and work unchanged on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.bags import cosines, plain
from evalspark.functions.text import words


def _bind(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` many times inside ``body``.

    A higher-order function evaluates whatever its lambda captures once per element; a
    lambda variable is the way to hold a computed array.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _starts(ordered: str) -> str:
    """Positions in a sorted array variable where a new element begins."""
    return (
        f"array_compact(transform({ordered}, (word, i) ->"
        f" CASE WHEN NOT (word <=> get({ordered}, i - 1)) THEN i END))"
    )


def _sum_of_squared_counts(ordered: str) -> str:
    """Sum over distinct elements of (occurrences squared), for a sorted array variable."""
    runs = f"transform(starts, (s, k) -> coalesce(get(starts, k + 1), size({ordered})) - s)"
    total = f"aggregate({runs}, 0L, (total, n) -> total + bigint(n) * n)"
    return _bind(_starts(ordered), "starts", total)


def _cosine(dot: str, square_x: str, square_y: str) -> str:
    norms = f"(double({square_x}) * double({square_y}))"
    return f"CASE WHEN {norms} > 0 THEN double({dot}) / sqrt({norms}) ELSE 0.0D END"


class TextSimilarity:
    """Cosine of the word-count vectors of text columns; 0.0 if either has no word.

    ``compared`` adds the cosines of several texts as columns, a batch of rows at a time, and a
    call names the column.  Unused groups are dropped with the texts that only they need.
    """

    def compared(self, rows: DataFrame, *groups: Sequence[str]) -> DataFrame:
        """``rows`` with the cosine of every pair within each group of text columns."""
        kept = rows.columns
        plains = rows.withColumns({f"plain_{t}": F.expr(plain(t)) for texts in groups for t in texts})
        found = plains.withColumns({
            f"cosines_{i}": cosines([f"plain_{t}" for t in texts]) for i, texts in enumerate(groups)
        })
        return found.selectExpr(*(f"`{c}`" for c in kept), *(
            f"cosines_{i}[{n}] AS {self(x, y)}"
            for i, texts in enumerate(groups)
            for n, (x, y) in enumerate(combinations(texts, 2))
        ))

    def __call__(self, x: str, y: str) -> str:
        return f"cosine_{x}_{y}"


def text_cosine(x: str, y: str) -> str:
    """The same cosine of two texts as one expression."""
    sides = f"array(sort_array({words(x)}), sort_array({words(y)}))"
    together = _bind(
        "sort_array(concat(sides[0], sides[1]))", "both", _sum_of_squared_counts("both")
    )
    left = _bind("sides[0]", "one", _sum_of_squared_counts("one"))
    right = _bind("sides[1]", "one", _sum_of_squared_counts("one"))
    value = _cosine("((q[2] - q[0] - q[1]) / 2)", "q[0]", "q[1]")
    return _bind(sides, "sides", _bind(f"array({left}, {right}, {together})", "q", value))


def dot_product(x: str, y: str) -> str:
    products = f"zip_with({x}, {y}, (a, b) -> double(a) * double(b))"
    return f"aggregate({products}, 0.0D, (total, v) -> total + v)"


def vector_cosine(x: str, y: str) -> str:
    """Cosine of two numeric arrays of one length; 0.0 if either has no length."""
    parts = f"array({dot_product(x, y)}, {dot_product(x, x)}, {dot_product(y, y)})"
    return _bind(parts, "d", _cosine("d[0]", "d[1]", "d[2]"))


def best_cosine(x: str, candidates: str) -> str:
    """Largest cosine of vector ``x`` to any vector of an array; NULL for an empty array."""
    return f"array_max(transform({candidates}, other -> {vector_cosine(x, 'other')}))"
