"""Adding computed columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add or replace columns given as SQL expressions over the existing ones."""
    return rows.withColumns({name: F.expr(sql) for name, sql in columns.items()})


def settle(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add columns that are computed once per row and then stand as values.

    A later filter on a plain computed column is pushed below it together with a copy of
    its expression; where columns build on each other the copies multiply.  A generated
    row is a boundary the optimizer does not copy expressions across.
    """
    values = ", ".join(f"'{name}', {sql}" for name, sql in columns.items())
    kept = [f"`{c}`" for c in rows.columns if c not in columns]
    return rows.selectExpr(*kept, f"inline(array(named_struct({values})))")
