"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents; where a stage
changes texts, ``n_chars`` follows them.  Documents of which nothing is left go.  Null texts count
as empty and null ids are kept, as each operator's module says; an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import line_dedup, packing, quality, simhash, store, substring_dedup


def _cleaned(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed documents with the columns of ``before``; those without a word are left out."""
    after = after.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in before.columns:
        after = after.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))
    return after.select(*(f"`{c}`" for c in before.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _cleaned(docs, line_dedup.remove_blocks(docs))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles chain within 2 of 64 bits."""
    return simhash.keep_one(docs, shingle=3, radius=2)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(docs, window=13, layout=True)
    return _cleaned(docs, found.select("doc_id", "text", "rest.*"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.cut_documents(docs, tokenizer, end_id=0, capacity=2048)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(store.written(pieces, "pieces"), capacity=2048)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("best_fit_packing", packed),
]

# Regressions, fingerprints and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
