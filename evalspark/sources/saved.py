"""A result table that grows batch by batch while others read it.

The table is a folder ``data`` of Parquet files and a folder ``log`` of versions.  A version is one
small file that lists the files that belong to the table and the batch each came with; it appears
whole, by the rename that ends Spark's own job.  Readers take the last version, so they see a batch, a
fill or a compaction whole or not at all, and a job that dies before its version leaves the table
as it was.  Files that no version lists any more are left to be cleaned up by age.

One writer at a time; any number of readers.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.incremental import NEEDS_FILL, fill_merge

LISTED = "file string, batch string, bytes long"


@dataclass(frozen=True)
class SavedTable:
    spark: SparkSession
    path: str
    schema: T.StructType

    def _files(self, folder: str, glob: str) -> DataFrame:
        """path and length of the files below a folder that Spark can list; none if there is no folder."""
        hadoop = self.spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        return hadoop.load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))

    def version(self) -> int:
        """Number of the last version; 0 before the first."""
        try:
            found = self._files(f"{self.path}/log", "part-*.json")
        except Exception as none:  # no folder yet
            if "PATH_NOT_FOUND" in str(none):
                return 0
            raise
        numbers = found.select(F.regexp_extract("file", r"/v(\d+)/part-", 1).cast("long").alias("n"))
        return numbers.agg(F.max("n")).first()[0] or 0

    def listed(self, version: int | None = None) -> DataFrame:
        """file, batch and bytes of the files of a version, the last one by default."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], LISTED)
        return self.spark.read.schema(LISTED).json(f"{self.path}/log/v{version:09d}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        return self._rows(self.listed(version))

    def _rows(self, listed: DataFrame) -> DataFrame:
        files = [r["file"] for r in listed.select("file").collect()]  # as many as Spark lists for any table
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*files)

    def _write(self, rows: DataFrame, batch: str | None) -> DataFrame:
        """Writes files that no version lists yet: file, batch, bytes."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.option("compression", "zstd").parquet(folder)
        return self._files(folder, "part-*").select("file", F.lit(batch).cast("string").alias("batch"), "bytes")

    def _commit(self, listed: DataFrame, after: int) -> None:
        """The version ``after`` + 1, in one file; an error if another writer was first."""
        listed.select("file", "batch", "bytes").coalesce(1).write.json(f"{self.path}/log/v{after + 1:09d}")

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Adds the rows of a batch; a batch that is in the table already is left alone (False)."""
        if "," in batch:
            raise ValueError("the name of a batch holds no comma")
        now = self.version()
        listed = self.listed(now)
        if not listed.where(F.array_contains(F.split("batch", ","), batch)).isEmpty():
            return False
        self._commit(listed.unionByName(self._write(rows, batch)), now)
        return True

    def put(self, rows: DataFrame, batch: str) -> None:
        """The rows of a batch in place of those it had; the batch has files of its own (no compaction)."""
        now = self.version()
        self._commit(self.listed(now).where(F.col("batch") != batch).unionByName(self._write(rows, batch)), now)

    def compact(self, least_bytes: int = 32 << 20) -> int:
        """Joins files smaller than ``least_bytes`` into some of about that size; how many went.

        The new files carry the names of all batches in them, so that a late repetition is still known.
        """
        now = self.version()
        listed = self.listed(now)
        small = listed.where(F.col("bytes") < least_bytes)
        sizes = small.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
        if sizes["n"] < 2:
            return 0
        rows = self._rows(small).coalesce(max(1, sizes["bytes"] // least_bytes))
        self._commit(listed.where(F.col("bytes") >= least_bytes).unionByName(self._write(rows, _batches(small))), now)
        return sizes["n"]

    def fill(self, replies: DataFrame, attempt: str | None = None) -> int:
        """``fill_merge`` on the files that hold a row to fill and a reply for it; how many were rewritten.

        The other files stay where they are.  The same replies a second time find nothing to fill.
        """
        now = self.version()
        listed = self.listed(now)
        pending = self._rows(listed).where(NEEDS_FILL).select("row_id", F.col("_metadata.file_path").alias("file"))
        touched = pending.join(replies.select("row_id"), "row_id", "left_semi").select("file").distinct()
        names = sorted({_plain(r["file"]) for r in touched.collect()})  # files, not rows
        if not names:
            return 0
        chosen = self.spark.createDataFrame([(n,) for n in names], "plain string")
        here = listed.withColumn("plain", F.regexp_replace("file", "^file:/+", "/"))
        old = here.join(chosen, "plain", "left_semi")
        # Only rows to fill are shuffled to their replies.
        rows = self._rows(old)
        filled = fill_merge(rows.where(NEEDS_FILL), replies, attempt).unionByName(rows.where(f"NOT coalesce({NEEDS_FILL}, false)"))
        filled = filled.coalesce(len(names))
        rest = here.join(chosen, "plain", "left_anti").drop("plain")
        self._commit(rest.unionByName(self._write(filled, _batches(old))), now)
        return len(names)


def _batches(listed: DataFrame) -> str:
    """The names of all batches of some files."""
    every = listed.select(F.explode(F.split("batch", ",")).alias("batch"))
    return every.agg(F.array_join(F.array_sort(F.collect_set("batch")), ",")).first()[0]


def _plain(file: str) -> str:
    return re.sub("^file:/+", "/", file)
