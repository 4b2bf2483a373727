"""Delimited text with quoted line breaks, read by many tasks, and the position of every record.

Spark cuts a text file into splits, and a split cannot tell whether it begins inside quotes.  Quotes come in
pairs (a quote in a text is doubled), so a line begins a record if the quotes before it in its file are
even in number.  A first pass counts, for each split, its quotes and the lines that begin a
record if the split begins outside quotes, and those if it begins inside; running sums over
the splits then say how each one begins and how many records are before it.  The second pass
numbers the lines with that and joins those of a record, also across splits.

All of it is SQL over lines: one shuffle of the lines by split, which is what Spark reads as one piece, and
another one for the records that go over the end of a split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions.text import quoted
from evalspark.operators.columns import add, settle

SPLIT = ("file", "split")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the place where their split starts, and a number that rises within the split."""
    return spark.read.option("lineSep", "\n").text(path).selectExpr(
        "_metadata.file_path AS file",
        "_metadata.file_block_start AS split",
        "monotonically_increasing_id() AS line",
        "value",
        "length(value) - length(replace(value, '\"', '')) AS quotes",
        r"value IN ('', '\r') AS blank",
    )


def _before(*columns: str, order: str, value: str) -> str:
    by = f"PARTITION BY {', '.join(columns)} " if columns else ""
    rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"coalesce(sum({value}) OVER ({by}ORDER BY {order} {rows}), 0L)"


def _in_order(order: str, value: str) -> str:
    return f"transform(sort_array(collect_list(struct({order}, {value}))), x -> x.{value})"


def _inside(lines: DataFrame) -> DataFrame:
    """``within``: quotes of the split before the line."""
    return add(lines, {"within": _before(*SPLIT, order="line", value="quotes")})


def _splits(lines: DataFrame) -> DataFrame:
    """One row a split: quotes before it in its file, records before it, and records before its file."""
    counted = _inside(lines.drop("value")).groupBy(*SPLIT).agg(
        F.sum("quotes").alias("quotes"),
        F.expr("count_if(within % 2 = 0 AND NOT blank)").alias("outside"),
        F.expr("count_if(within % 2 = 1 AND NOT blank)").alias("inside"),
    )
    opened = add(counted, {"opened": f"{_before('file', order='split', value='quotes')} % 2"})
    begun = add(opened, {"begun": "CASE opened WHEN 0 THEN outside ELSE inside END"})
    closed = f"raise_error(concat('a quote is never closed in ', {SPLIT[0]}))"
    return add(begun, {
        "before": _before("file", order="split", value="begun"),
        "total": "sum(quotes) OVER (PARTITION BY file)",
    }).selectExpr(
        *SPLIT, f"CASE total % 2 WHEN 0 THEN opened ELSE {closed} END AS opened", "before",
        # Over all splits: one row a split, some hundred megabytes of text.
        "dense_rank() OVER (ORDER BY file) - 1 AS files_before",
        f"{_before(order='file, split', value='begun')} - before AS records_before",
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 0 in each file), position and text of every record.

    ``position`` counts on from file to file, in the order of their names; ``files_before`` is the number of
    files before.  Blank lines between records are no records; a file may begin with a byte order mark
    and lines may end in CR LF.  A quote that is never closed is an error.
    """
    lines = _lines(spark, path)
    marked = _inside(lines).join(_splits(lines), [*SPLIT])
    open_ = "(opened + within) % 2 = 1"
    marked = add(marked, {"begins": f"NOT ({open_}) AND NOT blank"}).where(f"begins OR {open_}")
    through = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    numbered = add(marked, {
        "number": f"before + sum(int(begins)) OVER (PARTITION BY {', '.join(SPLIT)} ORDER BY line {through}) - 1"
    })
    keys = ["file", "number", "files_before", "records_before"]
    whole = "begins AND quotes % 2 = 0"
    single = numbered.where(whole).select(*keys, F.col("value").alias("text"))
    # Lines of one record in one split are where the split is; only what goes on in another split moves.
    pieces = numbered.where(f"NOT ({whole})").groupBy(*SPLIT, *keys[1:]).agg(
        F.expr(f"array_join({_in_order('line', 'value')}, '\\n')").alias("text"),
        F.expr("bool_or(begins) AND sum(quotes) % 2 = 0").alias("complete"),
    )
    inside = pieces.where("complete").select(*keys, "text")
    across = pieces.where("NOT complete").groupBy(*keys).agg(
        F.expr(f"array_join({_in_order('split', 'text')}, '\\n')").alias("text")
    )
    clean = r"regexp_replace(CASE number WHEN 0 THEN ltrim('﻿', text) ELSE text END, '\r$', '')"
    return single.unionByName(inside).unionByName(across).selectExpr(
        "file", "number", "files_before", "records_before + number AS position", f"{clean} AS text"
    )


OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"}


def read_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True, names: list[str] | None = None) -> DataFrame:
    """row_id and the columns (all strings) of quoted CSV files; row_id is the position without header lines.

    Every file must have the header (``names``, or else ``columns``); one that has another is refused by
    name when it is read.  A column ``row_id`` of the files is replaced.
    """
    fields = ", ".join(f"`{c}` string" for c in columns)
    options = ", ".join(f"'{k}', '{v}'" for k, v in OPTIONS.items())
    rows = settle(read_records(spark, path), {"cells": f"from_csv(text, {quoted(fields)}, map({options}))"})
    if not header:
        return rows.select(F.col("position").alias("row_id"), "cells.*")
    cells = "array(" + ", ".join(f"cells.`{c}`" for c in columns) + ")"
    expected = "array(" + ", ".join(map(quoted, names or columns)) + ")"
    wrong = "raise_error(concat('the header of ', file, ' is ', text))"
    kept = rows.where(f"CASE WHEN number > 0 THEN true WHEN {cells} <=> {expected} THEN false ELSE {wrong} END")
    kept = kept.select((F.col("position") - F.col("files_before") - 1).alias("row_id"), "cells")
    return kept.select("row_id", *(F.col(f"cells.`{c}`") for c in columns if c.lower() != "row_id"))


def numbered_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with ``row_id``, the position of the row: files in the order of their names, then rows.

    Rows are counted for each file first; no row moves for the count.  A column of that name is replaced.
    """
    table = spark.read.parquet(path)
    names = [c for c in table.columns if c.lower() != "row_id"]
    found = table.select("_metadata.file_path", "_metadata.row_index")
    files = found.groupBy("file_path").agg(F.count("*").alias("n"))
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row a file
    rows = table.select(*(f"`{c}`" for c in names), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))
    return rows.join(files, "file_path").select((F.col("before") + F.col("row_index")).alias("row_id"), *(f"`{c}`" for c in names))
