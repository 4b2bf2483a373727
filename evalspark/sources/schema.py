"""The result table: one row per question."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, types and order of the stored columns.
_FIELDS = (
    ("question", T.StringType()),
    ("answer_a", T.StringType()),
    ("answer_b", T.StringType()),
    ("similarity", T.DoubleType()),
    ("semantic_disagreement", T.BooleanType()),
    ("a_correct", T.BooleanType()),
    ("b_correct", T.BooleanType()),
    ("factual_disagreement", T.BooleanType()),
    ("status", T.StringType()),
    ("selected", T.StringType()),
    ("reason", T.StringType()),
    ("final_answer", T.StringType()),
    ("ensemble_correct", T.BooleanType()),
    ("base_answer", T.StringType()),
    ("base_correct", T.BooleanType()),
    ("base_judged", T.BooleanType()),
    ("ground_truth", T.StringType()),
)

RESULT_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in _FIELDS])
RESULT_COLUMNS = RESULT_SCHEMA.fieldNames()
FLAG_COLUMNS = [name for name, kind in _FIELDS if isinstance(kind, T.BooleanType)]

# The words a verdict may hold.
A_CORRECT = "A_CORRECT"
B_CORRECT = "B_CORRECT"
BOTH_CORRECT = "BOTH_CORRECT"
BOTH_WRONG = "BOTH_WRONG"
JUDGE_ERROR = "JUDGE_ERROR"
JUDGED_STATUSES = (A_CORRECT, B_CORRECT, BOTH_CORRECT, BOTH_WRONG)
SELECTION_OF = {A_CORRECT: "A", B_CORRECT: "B", BOTH_CORRECT: "BOTH", BOTH_WRONG: "NONE"}
NO_ANSWER = "NO_CORRECT_ANSWER"
FALLBACK_REASON = "Fallback semantic similarity evaluation used."
FALLBACK_MARK = "fallback semantic similarity"
SKIPPED_REASON = "ERROR: Skipped: one or both agent answers contained an error."

# Fixed value: cosine below this is disagreement, above it is a correct fallback grade.
SIMILARITY_THRESHOLD = 0.85
