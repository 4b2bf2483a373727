"""A run that saves as it goes and continues where it stopped.

Reply files land in a folder; each batch of files is evaluated and appended to the result
table.  The stream's checkpoint records which files are done, so a stopped run continues
with the first file that is not, and no row is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators.pipeline import Similarity, evaluate
from evalspark.operators.running import STATE, state_of
from evalspark.sources.saved import SavedTable

REPLY_SCHEMA = T.StructType(
    [T.StructField("row_id", T.LongType())]
    + [
        T.StructField(name, T.StringType())
        for name in ("question", "ground_truth", "reply_a", "reply_b", "reply_base", "verdict")
    ]
)


def reply_stream(spark: SparkSession, folder: str, files_per_batch: int = 25) -> DataFrame:
    """Reply files (Parquet) of a folder as a stream."""
    reader = spark.readStream.schema(REPLY_SCHEMA)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A folder for one run under the shared folder the cluster names."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir or pass a checkpoint folder")
    return f"{shared.rstrip('/')}/{name}"


def collect(
    replies: DataFrame,
    results_path: str,
    checkpoint: str | None = None,
    name: str = "results",
    similar: Similarity | None = None,
) -> StreamingQuery:
    """Evaluate everything that has arrived, append it to ``results_path``, then stop."""
    place = checkpoint or checkpoint_folder(replies.sparkSession, name)
    return (
        evaluate(replies, similar)
        .writeStream.format("parquet")
        .option("path", results_path)
        .option("checkpointLocation", place)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def state_table(spark: SparkSession, path: str) -> SavedTable:
    """The saved table of counts that ``collect_metrics`` fills and ``operators.running`` reads."""
    return SavedTable(spark, path, T.StructType.fromDDL(STATE))


def collect_metrics(
    replies: DataFrame,
    path: str,
    checkpoint: str | None = None,
    name: str = "metrics",
    similar: Similarity | None = None,
) -> StreamingQuery:
    """Count everything that has arrived, one row a batch in the state table at ``path``, then stop.

    A batch that ran before a failure but was not yet recorded runs again under its number and
    replaces its row.
    """
    place = checkpoint or checkpoint_folder(replies.sparkSession, name)

    def save(batch: DataFrame, number: int) -> None:
        state = f"{name} {number}"
        state_table(batch.sparkSession, path).put(state_of(evaluate(batch, similar), state), state)

    return (
        replies.writeStream.foreachBatch(save)
        .option("checkpointLocation", place)
        .trigger(availableNow=True)
        .start()
    )
