"""CSV, JSON, spreadsheet and text files at the edges; Parquet between stages."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TOPIC_NAMES

CSV = {"header": True, "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV whose cells may hold line breaks; all text unless a schema is given.  '' is null."""
    reader = spark.read.options(**CSV, multiLine=True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays of texts joined by ``;``."""
    return df.select(*[F.array_join(c, ";").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Arrays are joined by ``;``, as CSV has none."""
    flat(df).write.mode("overwrite").options(**CSV).partitionBy(*partition_by).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows to a CSV folder, header and all, as files of their own."""
    flat(df).write.mode("append").options(**CSV).csv(path)


def read_related_tags(spark: SparkSession, path: str) -> DataFrame:
    """site, tag of stored tag metrics, each once; a site without any simply has no rows."""
    return spark.read.parquet(path).select("site", "tag").where("tag IS NOT NULL").distinct()


def write_stage(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Writes a stage as Parquet and returns it as read back, which ends its lineage."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, *keys: str) -> DataFrame:
    """Keeps a stage as a table whose rows lie in buckets by hash of the keys, sorted by them within each, and returns it.

    Joins and groups on the keys of such tables need no exchange of rows.  Take
    as many buckets as keep one within a task's memory (128 MB to 1 GB each).
    """
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def read_topic_names(spark: SparkSession, path: str) -> DataFrame:
    """topic_index, topic_name from stored answers; both spellings of the keys count."""
    rows = spark.read.schema(TOPIC_NAMES).option("multiLine", True).json(path).select(F.inline("topics"))
    return rows.select(F.coalesce("topic_index", "topic_id").alias("topic_index"), F.coalesce("topic_name", "inferred_name").alias("topic_name")).where("topic_index IS NOT NULL")


def read_topic_names_or_default(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """Names of a model (``main``, or a submodel's id); empty where none are stored."""
    from .dumps import exists

    path = f"{folder.rstrip('/')}/topic_inference_{model}.json"
    if exists(spark, path):
        return read_topic_names(spark, path)
    return spark.createDataFrame([], "topic_index bigint, topic_name string")


def read_model_meta(spark: SparkSession, path: str) -> DataFrame:
    """num_topics, alpha, beta, random_seed, coherence, perplexity; what is absent is null."""
    schema = "num_topics int, alpha double, beta double, random_seed bigint, coherence double, perplexity double"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_lines(df: DataFrame, path: str, order: str, line: str = "line") -> None:
    """A report as one text file; reports have a line a topic or subtopic."""
    df.orderBy(order).select(line).coalesce(1).write.mode("overwrite").text(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A validation sheet from CSV, or from a spreadsheet where openpyxl is installed."""
    if not path.endswith((".xlsx", ".xls")):
        return read_csv(spark, path)
    try:
        import openpyxl
    except ModuleNotFoundError as e:
        raise RuntimeError("reading spreadsheets needs openpyxl; save the sheet as CSV") from e
    rows = list(openpyxl.load_workbook(path, read_only=True).active.iter_rows(values_only=True))
    schema = T.StructType([T.StructField(str(h), T.StringType()) for h in rows[0]])
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows[1:]], schema)


def write_sheet(sheet: DataFrame, path: str, name: str = "validation_sample") -> None:
    """A validation sample is a few hundred rows, which is what a spreadsheet on the driver holds."""
    if not path.endswith(".xlsx"):
        write_csv(sheet.coalesce(1), path)
        return
    try:
        from openpyxl import Workbook
    except ModuleNotFoundError as e:
        raise RuntimeError("writing spreadsheets needs openpyxl; write CSV") from e
    book = Workbook()
    page = book.active
    page.title = name
    page.append(sheet.columns)
    for row in sheet.toLocalIterator():
        page.append(list(row))
    book.save(path)


def read_prompt(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
