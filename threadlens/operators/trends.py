"""Topics over the years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topic_trend(questions: DataFrame) -> DataFrame:
    """year, topic, n, total, pct: a year's total counts questions without a topic too; no date, no row."""
    dated = questions.withColumn("year", F.year("creation_date")).where("year IS NOT NULL")
    cells = dated.groupBy("year", "topic").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("year").agg(F.sum("n").alias("total"))
    return cells.where("topic IS NOT NULL").join(totals, "year").select("year", "topic", "n", "total", (F.col("n") * 100.0 / F.col("total")).alias("pct"))
