"""Use of languages and technologies, and how it spreads over topics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CROSS_CUTTING_TOPICS, SPECIFIC_PEAK, TOPIC_IDS
from ..functions.technology import NONE, main_language, name_part, share_part

PATTERNS = ("cross-cutting", "topic-specific", "sparse")


def taxonomy(spark: SparkSession, categories: Mapping[str, list[str]]) -> DataFrame:
    """category, category_pos, pos, tech, global_pct from categories of ``"name (share)"`` labels."""
    rows = [(c, k, j, label) for k, (c, labels) in enumerate(categories.items()) for j, label in enumerate(labels)]
    df = spark.createDataFrame(rows, "category string, category_pos int, pos int, label string")
    return parted(df).drop("label")


def parted(labels: DataFrame, label: str = "label") -> DataFrame:
    """Adds tech and global_pct, the parts of ``"name (share)"`` labels; a share that is no number counts as 0."""
    return labels.withColumns({"tech": name_part(F.col(label)), "global_pct": share_part(F.col(label))})


def language_shares(posts: DataFrame, technologies: str = "technologies") -> DataFrame:
    """language, n, pct of all posts; posts without a language count in the base only."""
    total = posts.agg(F.count(F.lit(1)).alias("total"))
    counted = posts.groupBy(main_language(F.col(technologies)).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("language") != NONE).join(F.broadcast(total)).select("language", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def technology_counts(posts: DataFrame, technologies: str = "technologies_clean") -> DataFrame:
    """tech, n, pct: occurrences, repeats within a post counted, in shares of all posts."""
    total = posts.agg(F.count(F.lit(1)).alias("total"))
    terms = posts.select(F.explode(F.split(technologies, ",")).alias("tech"))
    terms = terms.select(F.lower(F.replace(F.btrim("tech"), F.lit("\u00a0"), F.lit(""))).alias("tech")).where("tech <> ''")
    return terms.groupBy("tech").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("tech", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def technology_by_topic(posts: DataFrame, technologies: str = "technologies_clean", key: str = "post_id") -> DataFrame:
    """tech, topic, n (distinct posts), pct of the topic's posts; empty and missing terms are ``n/a``."""
    per_topic = posts.where("topic IS NOT NULL").groupBy("topic").agg(F.count(F.lit(1)).alias("n_topic"))
    terms = posts.where("topic IS NOT NULL").select("topic", key, F.explode(F.split(F.coalesce(F.col(technologies), F.lit(NONE)), ",")).alias("tech"))
    terms = terms.withColumn("tech", F.lower(F.btrim("tech"))).withColumn("tech", F.when(F.col("tech").isin("", "nan", "none"), F.lit(NONE)).otherwise(F.col("tech")))
    counts = terms.groupBy("tech", "topic").agg(F.countDistinct(key).alias("n"))
    return counts.join(per_topic, "topic", "left").select("tech", "topic", "n", (F.col("n") * 100.0 / F.coalesce("n_topic", F.lit(1))).alias("pct"))


def technology_pivot(by_topic: DataFrame, topic_ids=TOPIC_IDS) -> DataFrame:
    """tech and a column a topic id with the share there, 0 where there is none."""
    return by_topic.groupBy("tech").pivot("topic_id", list(topic_ids)).agg(F.first("pct")).na.fill(0.0, list(topic_ids))


def usage_patterns(by_topic: DataFrame, topic_ids=TOPIC_IDS, min_topics: int = CROSS_CUTTING_TOPICS, min_peak: float = SPECIFIC_PEAK) -> DataFrame:
    """tech, n_topics, max_pct, pattern: over the listed topics only."""
    listed = F.col("topic_id").isin(*topic_ids)
    out = by_topic.groupBy("tech").agg(F.count_if(listed & (F.col("pct") > 0)).alias("n_topics"), F.coalesce(F.max(F.when(listed, F.col("pct"))), F.lit(0.0)).alias("max_pct"))
    pattern = F.when(F.col("n_topics") >= min_topics, F.lit(PATTERNS[0])).when(F.col("max_pct") >= min_peak, F.lit(PATTERNS[1])).otherwise(F.lit(PATTERNS[2]))
    return out.withColumn("pattern", pattern)


def pattern_table(patterns: DataFrame, terms: DataFrame, omit=()) -> DataFrame:
    """category and the number of its technologies of each pattern, with a Total row; categories without any have zeros."""
    terms = terms.where(~F.col("category").isin(*omit)) if omit else terms
    joined = terms.select("category", "category_pos", "tech").distinct().join(patterns.select("tech", "pattern"), "tech", "left")
    counts = [F.count_if(F.col("pattern") == p).alias(p) for p in PATTERNS]
    table = joined.groupBy("category", "category_pos").agg(*counts)
    total = table.agg(*[F.coalesce(F.sum(p), F.lit(0)).cast("bigint").alias(p) for p in PATTERNS]).select(F.lit("Total").alias("category"), F.lit(None).cast("int").alias("category_pos"), *PATTERNS)
    return table.select("category", "category_pos", *PATTERNS).unionByName(total).orderBy(F.col("category_pos").asc_nulls_last()).select("category", *PATTERNS)


def pattern_shares(table: DataFrame) -> DataFrame:
    """Each category's patterns in percent of its technologies; null for one without any."""
    row = sum((F.col(p) for p in PATTERNS[1:]), F.col(PATTERNS[0]))
    return table.where("category <> 'Total'").select("category", *[F.try_divide(F.col(p) * 100.0, row).alias(p) for p in PATTERNS])


def heatmap(by_topic: DataFrame, terms: DataFrame, pattern: str | None = None, least_share: float | None = None, topic_ids=TOPIC_IDS) -> DataFrame:
    """Listed technologies with their pattern, spread and shares by topic, widest and strongest first.

    ``least_share`` keeps those with at least that global share.
    """
    if least_share is not None:
        terms = terms.where(F.col("global_pct") >= least_share)
    listed = terms.select("tech", "category", "global_pct")
    out = listed.join(usage_patterns(by_topic, topic_ids), "tech").join(technology_pivot(by_topic, topic_ids), "tech")
    if pattern is not None:
        out = out.where(F.col("pattern") == pattern)
    return out.orderBy(F.col("n_topics").desc(), F.col("max_pct").desc(), "tech")
