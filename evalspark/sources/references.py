"""Reference answer sets and category maps, one row per question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reference_sets(rows: DataFrame, correct: str = "correct", incorrect: str = "incorrect"
                   ) -> DataFrame:
    """One reference set per question; the row with the highest ``row_id`` wins.

    Only numbers are aggregated; the texts are then taken from the rows that won.
    """
    last = rows.groupBy("question").agg(F.max("row_id").alias("row_id"))
    return rows.join(last, ["question", "row_id"]).select(
        "question", F.col(correct).alias("correct"), F.col(incorrect).alias("incorrect")
    )


def category_map(rows: DataFrame, category: str = "category") -> DataFrame:
    """One category per question; the row with the highest ``row_id`` wins."""
    return rows.groupBy("question").agg(F.max_by(category, "row_id").alias("category"))


def read_category_map(spark: SparkSession, path: str) -> DataFrame:
    """Read a JSON object ``{question: category}`` as two columns (one file is one task)."""
    entries = F.from_json("value", "map<string,string>")
    return spark.read.text(path, wholetext=True).select(
        F.explode(entries).alias("question", "category")
    )
