"""A CSV sink that takes each batch of a stream exactly once.

A batch is written to a hidden draft and committed by renaming it to a folder
that bears its number.  The folders are the ledger: a batch whose folder is
there was written whole, and a replay of it does nothing; what a killed attempt
left behind is hidden from readers and replaced.  It takes a file system on
which renaming a folder is one step and fails where the name is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..lineage import remove
from ..sources.tables import CSV, flat


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that appends batches to a CSV folder."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, place = _fs(spark, path)
        done, draft = place(f"{path}/batch={number}"), place(f"{path}/_draft/{number}")
        if fs.exists(done):
            return
        remove(spark, draft.toString())
        flat(batch).write.options(**CSV).csv(draft.toString())
        if not fs.rename(draft, done) and not fs.exists(done):
            raise OSError(f"batch {number} could not be committed to {path}")

    return take


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were written whole."""
    fs, place = _fs(spark, path)
    if not fs.exists(place(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place(path))]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def read_appended(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all committed batches; drafts are hidden by their name."""
    if not committed(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.options(**CSV, multiLine=True).schema(schema).csv(f"{path}/batch=*")


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark._jsc.hadoopConfiguration()), place
