"""How questions spread over topics and subtopics, and how both form a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TOPIC_THEMES
from ..schema import require


def with_topic(questions: DataFrame, topic: str = "topic") -> DataFrame:
    return questions.where(F.col(topic).isNotNull())


def topic_distribution(questions: DataFrame) -> DataFrame:
    """topic, n, pct of all questions (unclassified ones included), avg_contribution."""
    require(questions, "topic", topic_perc_contrib="number")
    total = questions.agg(F.count(F.lit(1)).alias("total"))
    by_topic = questions.where("topic IS NOT NULL").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.avg("topic_perc_contrib").alias("avg_contribution"))
    return by_topic.join(F.broadcast(total)).select("topic", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"), "avg_contribution")


def subtopic_coverage(questions: DataFrame) -> DataFrame:
    """topic, n_questions, n_with_subtopic, avg_contribution of the subtopic."""
    require(questions, "topic", "subtopic", subtopic_perc_contrib="number")
    return questions.where("topic IS NOT NULL").groupBy("topic").agg(F.count(F.lit(1)).alias("n_questions"), F.count("subtopic").alias("n_with_subtopic"), F.avg("subtopic_perc_contrib").alias("avg_contribution"))


def validated(sheet: DataFrame) -> DataFrame:
    """Rows that raters found right in both topic and subtopic (null is not right)."""
    require(sheet, topic_veredict="flag", subtopic_veredict="flag")
    return sheet.where(F.col("topic_veredict") & F.col("subtopic_veredict"))


def hierarchy(posts: DataFrame) -> DataFrame:
    """topic, subtopic, n_topic, pct_topic, n_subtopic, pct_subtopic.

    Topics in shares of all posts, subtopics in shares of their topic.  A post
    without a topic counts in the total only; one without a subtopic has no
    row below its topic.
    """
    require(posts, "topic", "subtopics")
    total = posts.agg(F.count(F.lit(1)).alias("total"))
    pairs = posts.where("topic IS NOT NULL").groupBy("topic", F.col("subtopics").alias("subtopic")).agg(F.count(F.lit(1)).alias("n_subtopic"))
    topics = pairs.groupBy("topic").agg(F.sum("n_subtopic").alias("n_topic"))
    out = pairs.where("subtopic IS NOT NULL").join(topics, "topic").join(F.broadcast(total))
    return out.select("topic", "subtopic", "n_topic", (F.col("n_topic") * 100.0 / F.col("total")).alias("pct_topic"), "n_subtopic", (F.col("n_subtopic") * 100.0 / F.col("n_topic")).alias("pct_subtopic"))


def hierarchy_summary(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count(F.lit(1)).alias("total_posts"), F.countDistinct("topic").alias("total_topics"), F.countDistinct("subtopics").alias("total_unique_subtopics"))


def nested_hierarchy(levels: DataFrame) -> DataFrame:
    """One row a topic, its subtopics as an array from the most to the least frequent."""
    inner = F.struct((-F.col("n_subtopic")).alias("o"), F.col("subtopic").alias("name"), F.col("n_subtopic").alias("count"), F.col("pct_subtopic").alias("pct"))
    listed = F.transform(F.array_sort(F.collect_list(inner)), lambda s: F.struct(s["name"].alias("name"), s["count"].alias("count"), s["pct"].alias("pct")))
    return levels.groupBy("topic", "n_topic", "pct_topic").agg(listed.alias("subtopics"))


def report_lines(levels: DataFrame) -> DataFrame:
    """The report's lines in order: topics by falling share, each followed by its subtopics."""
    topic_line = F.format_string("%s: %.2f%% (%d posts)", "topic", "pct_topic", "n_topic")
    sub_line = F.format_string("  - %s: %.2f%% (%d posts)", "subtopic", "pct_subtopic", "n_subtopic")
    tops = levels.select("topic", "n_topic", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("o"), F.lit("").alias("s"), topic_line.alias("line")).distinct()
    subs = levels.select("topic", "n_topic", F.lit(1).alias("level"), (-F.col("n_subtopic")).alias("o"), F.col("subtopic").alias("s"), sub_line.alias("line"))
    return tops.unionByName(subs).orderBy(F.col("n_topic").desc(), "topic", "level", "o", "s").select("line")


def top_subtopics(levels: DataFrame, k: int = 3) -> DataFrame:
    """topic, rank, subtopic, pct_subtopic: the k most frequent of each topic, ties by name."""
    order = Window.partitionBy("topic").orderBy(F.col("n_subtopic").desc(), "subtopic")
    return levels.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("topic", "rank", "subtopic", "pct_subtopic")


def theme_of(number: Column, themes=None) -> Column:
    """The theme of a topic's number; null for one in no theme."""
    out = F.lit(None).cast("string")
    for theme, numbers in reversed(list((themes or TOPIC_THEMES).items())):
        out = F.when(number.isin(*numbers), F.lit(theme)).otherwise(out)
    return out
