"""Stratified validation samples: sample size, Neyman allocation, selection, and the sheet."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SAMPLE_E, SAMPLE_P, SAMPLE_Z
from ..functions.tags import question_link
from ..schema import require


def z_of(confidence: float) -> float:
    """The two-sided normal quantile of a confidence level, to two decimals as tables give it (0.95: 1.96)."""
    if not 0 < confidence < 1:
        raise ValueError(f"confidence {confidence!r} does not lie between 0 and 1")
    return round(NormalDist().inv_cdf((1 + confidence) / 2), 2)


def sample_size(population: Column, z: float = SAMPLE_Z, p: float = SAMPLE_P, e: float = SAMPLE_E) -> Column:
    """Sample size with finite population correction, as a fraction (Cochran's formula)."""
    n0 = z**2 * p * (1 - p) / e**2
    return F.lit(n0) / (F.lit(1.0) + F.lit(n0 - 1) / population)


def strata(questions: DataFrame, topic: str = "topic", contribution: str = "topic_perc_contrib") -> DataFrame:
    """topic, stratum_size, within_sd; questions without a topic are in no stratum."""
    require(questions, topic, **{contribution: "number"})
    return questions.where(F.col(topic).isNotNull()).groupBy(F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("stratum_size"), F.stddev_samp(contribution).alias("within_sd"))


def allocation(sizes: DataFrame, population: Column | int, **options) -> DataFrame:
    """Adds allocated: Neyman allocation, rounded up, then lowered to the target.

    The fractional sample size is dealt out in proportion to size x deviation
    (a single-member stratum has deviation 0).  Every share is rounded up; the
    excess over the rounded-up sample size comes off, one each, the strata that
    gained least by rounding, ties by topic.  One row a stratum.
    """
    require(sizes, "topic", stratum_size="number", within_sd="number")
    everything = Window.partitionBy()
    n = sample_size(F.lit(population) if isinstance(population, int) else population, **options)
    weight = F.col("stratum_size") * F.coalesce("within_sd", F.lit(0.0))
    out = sizes.withColumn("_n", n).withColumn("_raw", F.coalesce(F.try_divide(F.col("_n") * weight, F.sum(weight).over(everything)), F.lit(0.0)))
    out = out.withColumn("_up", F.ceil("_raw").cast("bigint"))
    excess = F.sum("_up").over(everything) - F.ceil("_n").cast("bigint")
    # Strata without a share have nothing to give; gains that differ by rounding noise only count as equal.
    rank = F.row_number().over(Window.orderBy(F.col("_up") <= 0, F.round(F.col("_up") - F.col("_raw"), 9), "topic"))
    return out.withColumn("allocated", (F.col("_up") - F.when(rank <= excess, 1).otherwise(0)).cast("bigint")).drop("_n", "_raw", "_up")


def allocated_sample(questions: DataFrame, allocated: DataFrame, contribution: str = "topic_perc_contrib", key: str = "question_id") -> DataFrame:
    """Of each topic the questions with the largest contribution, as many as allocated.

    The largest allocation bounds the ranks before questions are dealt by topic,
    so no task orders a whole topic.
    """
    require(questions, "topic", key, **{contribution: "number"})
    require(allocated, "topic", allocated="number")
    most = allocated.agg(F.max("allocated")).first()[0] or 0  # one row a topic
    order = Window.partitionBy("topic").orderBy(F.col(contribution).desc_nulls_last(), key)
    ranked = questions.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).join(allocated.select("topic", "allocated"), "topic")
    return ranked.where("_rank <= allocated").select(questions.columns)


def validation_sheet(sample: DataFrame) -> DataFrame:
    """The twelve columns of the sheet that raters fill in; the first column named like a subtopic gives subtopics."""
    require(sample, "question_id", "site_alias", "topic")
    sub = next((c for c in sample.columns if "subtopic" in c.lower()), None)
    alias = F.col("site_alias")
    shown = [F.col("question_id").cast("string").alias("id"), alias.alias("site"), F.col("topic").cast("string").alias("topic"), (F.col(sub).cast("string") if sub else F.lit(None).cast("string")).alias("subtopics"), question_link(alias, F.col("question_id").cast("string")).alias("link")]
    blank = ("topic_validation_1", "topic_validation_2", "topic_veredict", "subtopic_validation_1", "subtopic_validation_2", "subtopic_veredict", "technologies")
    return sample.select(*shown, *[F.lit("").alias(c) for c in blank])
