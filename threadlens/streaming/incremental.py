"""Incremental forms of aggregates that are sums: they run on streams with event time.

The batch operators stay the reference; these add an event-time window and a
watermark, so that state is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_counts_stream(questions: DataFrame, anchor: str, window: str = "1 day", late: str = "1 day", time: str = "creation_date") -> DataFrame:
    """start, site, tag, b, a by window of time."""
    tags = questions.withWatermark(time, late).select(time, "site", F.array_contains("tags", anchor).alias("anchored"), F.explode("tags").alias("tag"))
    counts = tags.groupBy(F.window(time, window), "site", "tag").agg(F.count(F.lit(1)).alias("b"), F.count_if("anchored").alias("a"))
    return counts.select(F.col("window.start").alias("start"), "site", "tag", "b", "a")


def census_stream(posts: DataFrame, window: str = "1 day", late: str = "1 day", time: str = "creation_date") -> DataFrame:
    """start, site, questions, answers by window of time."""
    counts = posts.withWatermark(time, late).groupBy(F.window(time, window), "site").agg(F.count_if(F.col("post_type") == "1").alias("questions"), F.count_if(F.col("post_type") == "2").alias("answers"))
    return counts.select(F.col("window.start").alias("start"), "site", "questions", "answers")


def trend_stream(questions: DataFrame, window: str = "30 days", late: str = "7 days", time: str = "creation_date") -> DataFrame:
    """start, topic, n by window of time; shares follow from the sums in any later batch."""
    counts = questions.withWatermark(time, late).groupBy(F.window(time, window), "topic").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "topic", "n")
