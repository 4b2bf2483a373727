"""Evaluation inputs derived from the given tables, whole tables and whole texts.

Every document is a question with two agents' replies, a baseline reply and a judge's
reply.  Document ids only decide which shape a row takes (a failed call, a think block, a
broken verdict, ...); no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.text import clean_output
from evalspark.operators import pipeline
from evalspark.sources.references import reference_sets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, read as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUESTION = "concat('Which ', lang, ' text has ', string(n_chars), ' characters?')"
DISTINCT_WORDS = "array_join(array_distinct(split(text, ' ')), ' ')"


def _longer_than(n: int) -> str:
    return f"array_join(filter(split(text, ' '), w -> length(w) > {n}), ' ')"


def _word(flag: str) -> str:
    """A JSON boolean, every third time as a string."""
    mark = "CASE WHEN doc_id % 3 = 0 THEN '\"' ELSE '' END"
    return f"{mark}, string({flag}), {mark}"


_REPLY_A = f"""CASE WHEN doc_id % 29 = 28 THEN 'ERROR: timeout 503'
  WHEN doc_id % 31 = 30 THEN '' ELSE {_longer_than(3)} END"""

_REPLY_B = r"""CASE doc_id % 5 WHEN 0 THEN concat('<think>{', lang, '}</think>', text)
  WHEN 1 THEN concat(source, '</think>', text)
  WHEN 2 THEN concat(' \t', text, ' \n') ELSE text END"""

_REPLY_BASE = f"""CASE WHEN doc_id % 7 = 6 THEN NULL
  WHEN doc_id % 37 = 36 THEN 'ERROR: tokens per day'
  ELSE concat(CASE WHEN doc_id % 4 = 3 THEN '<think>' ELSE '' END, {_longer_than(2)}) END"""

_STATUS_WORD = """CASE WHEN doc_id % 17 = 3 THEN 'UNSURE'
  WHEN doc_id % 13 = 5 THEN lower(word) ELSE word END"""

# The judge's JSON from the labels, in every state a model may leave it.
_BODY = f"""concat('{{"answer_a_correct": ',
  CASE WHEN doc_id % 19 = 4 THEN 'null' ELSE concat({_word('good')}) END,
  ', "answer_b_correct": ', {_word('harmless')},
  ', "baseline_correct": ', {_word('good AND harmless')}, ', ',
  CASE WHEN doc_id % 23 = 7 THEN ''
       ELSE concat('"selection_status": "', {_STATUS_WORD}, '", ') END,
  '"selected_answer": "', {pipeline.selection_of('word')},
  '", "reason": "quality ', string(quality), ' toxic ', string(toxic), '"',
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE '}}' END)"""

_VERDICT = r"""CASE WHEN doc_id % 43 = 42 THEN 'ERROR: 503 service unavailable'
  WHEN quality IS NULL THEN concat('No verdict on this ', lang)
  ELSE concat(CASE WHEN doc_id % 5 = 0 THEN '<think>x { y</think>\n' ELSE '' END,
    CASE WHEN doc_id % 2 = 1 THEN 'Verdict: ' ELSE '' END,
    body, CASE WHEN doc_id % 41 = 40 THEN concat(' ', body) ELSE '' END,
    CASE WHEN doc_id % 2 = 1 THEN ' (end)' ELSE '' END) END"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their labels where there are any.

    Spark sends small labels to the documents, and shuffles or sorts both where they are large.
    """
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "quality", "toxic", "quality = 1 AS good", "toxic = 0 AS harmless"
    )
    return docs.select("doc_id", "text", "lang", "source", "n_chars").join(
        labels, "doc_id", "left"
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies: row_id, question, category, ground_truth, reply_*, verdict."""
    worded = _labelled(spark, sf_dir).selectExpr(
        "*", f"{pipeline.status_of('good', 'harmless')} AS word"
    )
    return worded.selectExpr("*", f"{_BODY} AS body").selectExpr(
        "doc_id AS row_id",
        f"{QUESTION} AS question",
        "source AS category",
        f"{DISTINCT_WORDS} AS ground_truth",
        f"{_REPLY_A} AS reply_a",
        f"{_REPLY_B} AS reply_b",
        f"{_REPLY_BASE} AS reply_base",
        f"{_VERDICT} AS verdict",
    )


def results(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The result table of all documents."""
    return pipeline.evaluate(replies(spark, sf_dir), keep=("category",), **options)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference sets: a text's lines with a comma count as correct, those without as not."""
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS row_id",
        f"{QUESTION} AS question",
        r"filter(split(text, '\n'), s -> contains(s, ',')) AS correct",
        r"filter(split(text, '\n'), s -> NOT contains(s, ',')) AS incorrect",
    )
    return reference_sets(rows)


def base_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A late baseline reply for every document, with the baseline judge's reply."""
    judged = f"""concat('{{"answer_correct": ', {_word('good')}, '}}')"""
    return (
        _labelled(spark, sf_dir)
        .selectExpr(
            "doc_id AS row_id",
            "lang",
            f"{DISTINCT_WORDS} AS ground_truth",
            f"CASE WHEN doc_id % 3 = 1 THEN 'ERROR: timed out' ELSE {clean_output('text')} END"
            " AS base_answer",
            f"CASE WHEN good IS NULL THEN 'no json' ELSE {judged} END AS verdict",
        )
    )


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as model calls; events of type error carry one of five messages."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """CASE WHEN event_type = 'error' THEN CASE event_id % 5
             WHEN 0 THEN 'Tokens per day limit (TPD) reached'
             WHEN 1 THEN 'HTTP 429: rate limit' WHEN 2 THEN 'Request timed out'
             WHEN 3 THEN 'Model not found' ELSE 'httpd failed' END END AS message""",
    )


def flag_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags written as the words an exported table may hold."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS row_id",
        "CASE doc_id % 5 WHEN 0 THEN ' True ' WHEN 1 THEN 'FALSE' WHEN 2 THEN ''"
        " WHEN 3 THEN 'nan' END AS flag",
    )


def vector_raters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as answers and references: ten vectors in a row answer one question, and
    the ten before them are its reference set (even labels are correct)."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.selectExpr(
        "vec_id AS row_id", "vec_id DIV 10 AS question", "embedding AS vector",
        "label < 5 AS judge",
    )
    sets = vectors.groupBy(F.expr("vec_id DIV 10 + 1").alias("question")).agg(
        F.expr("collect_list(CASE WHEN label % 2 = 0 THEN embedding END)").alias("correct"),
        F.expr("collect_list(CASE WHEN label % 2 <> 0 THEN embedding END)").alias("incorrect"),
    )
    return rows, sets


def stored_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table as an earlier run may have stored it: all documents, their whole text as one
    agent's answer, flags from the labels; every seventh row has no baseline answer yet."""
    rows = _labelled(spark, sf_dir).selectExpr(
        "*", "doc_id % 100 / 100.0D AS near", "coalesce(good, false) AS a", "coalesce(harmless, true) AS b"
    )
    rows = rows.selectExpr("*", f"{pipeline.status_of('a', 'b')} AS word")
    return rows.selectExpr(
        "doc_id AS row_id",
        f"{QUESTION} AS question",
        "text AS answer_a",
        "CASE WHEN doc_id % 31 = 30 THEN 'ERROR: timeout 503' ELSE source END AS answer_b",
        "near AS similarity",
        "near < 0.85D AS semantic_disagreement",
        "a AS a_correct", "b AS b_correct", "a <> b AS factual_disagreement",
        "CASE WHEN doc_id % 43 = 42 THEN 'JUDGE_ERROR' ELSE word END AS status",
        f"{pipeline.selection_of('word')} AS selected",
        "concat('seen ', lang) AS reason",
        "CASE WHEN a OR b THEN source ELSE 'NO_CORRECT_ANSWER' END AS final_answer",
        "a OR b AS ensemble_correct",
        "CASE WHEN doc_id % 7 <> 6 THEN source END AS base_answer",
        "CASE WHEN doc_id % 7 <> 6 THEN a END AS base_correct",
        "CASE WHEN doc_id % 7 <> 6 THEN b END AS base_judged",
        "source AS ground_truth",
    )


def late_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline replies for ``stored_run``, German ones missing; every fifth failed at first."""
    rows = table(spark, sf_dir, "documents").where("lang <> 'de'")
    cells = "row_id", "base_answer", "base_correct", "base_judged", "attempt"
    second = rows.selectExpr(
        "doc_id AS row_id", "concat('late ', source) AS base_answer",
        "n_chars % 2 = 0 AS base_correct", "n_chars % 3 = 0 AS base_judged", "2 AS attempt",
    )
    first = rows.where("doc_id % 5 = 0").selectExpr(
        "doc_id AS row_id", "'ERROR: 429' AS base_answer", "false AS base_correct",
        "false AS base_judged", "1 AS attempt",
    )
    return second.select(*cells).unionByName(first.select(*cells))
