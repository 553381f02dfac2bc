"""Popularity and difficulty of topics, each metric relative to the mean of all topics' means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import hours_between
from ..schema import require

_POPULARITY = (("view_count", "avg_views", "V_hat"), ("score", "avg_score", "S_hat"), ("comment_count", "avg_comments", "C_hat"))


def _all() -> Window:
    return Window.partitionBy()


def relative(column: str) -> Column:
    """A topic's value over the unweighted mean of topics; 0 where that mean is 0."""
    mean = F.avg(column).over(_all())
    return F.when(mean == 0, F.lit(0.0)).otherwise(F.col(column) / mean)


def popularity(questions: DataFrame) -> DataFrame:
    """topic, the means of views, score and comments, their relative values, fused_popularity."""
    require(questions, "topic", view_count="number", score="number", comment_count="number")
    means = questions.where("topic IS NOT NULL").groupBy("topic").agg(*[F.avg(c).alias(m) for c, m, _ in _POPULARITY])
    # A mean of 0 makes the relative value undefined here, not 0.
    hats = means.withColumns({h: F.try_divide(F.col(m), F.avg(m).over(_all())) for _, m, h in _POPULARITY})
    known = [F.col(h) for _, _, h in _POPULARITY]
    total = sum((F.coalesce(k, F.lit(0.0)) for k in known[1:]), F.coalesce(known[0], F.lit(0.0)))
    n = sum((k.isNotNull().cast("int") for k in known[1:]), known[0].isNotNull().cast("int"))
    return hats.withColumn("fused_popularity", F.try_divide(total, n))


def accepted_hours(questions: DataFrame, answers: DataFrame, thread: str | None = None) -> DataFrame:
    """topic, hours from a question to its accepted answer; negative and unknown spans are left out.

    ``thread`` names a column of both sides that the question and its answers
    share; where tables lie in buckets by it, nothing is exchanged.
    """
    require(questions, "topic", "accepted_answer_id", creation_date="time")
    require(answers, "id", creation_date="time")
    done = answers.select(F.col("id").alias("_answer"), *([thread] if thread else []), F.col("creation_date").alias("_answered"))
    asked, named = questions.where("accepted_answer_id IS NOT NULL"), F.col("accepted_answer_id")
    # Beside the thread, the answer is compared by its order: a second key of equality would have both sides dealt out anew.
    spans = asked.join(done, thread).where(named.between(F.col("_answer"), F.col("_answer"))) if thread else asked.join(done, named == F.col("_answer"))
    return spans.select("topic", hours_between(F.col("creation_date"), F.col("_answered")).alias("hours")).where("hours >= 0")


def difficulty(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """topic, avg_hours, avg_no_accepted_answer, T_hat, P_hat, fused_difficulty.

    A question counts as accepted if it names an accepted answer, even one that
    is not in the data.  A topic without hours takes the mean of the others'
    (1 if there are none); without questions its share of unaccepted is 0.
    """
    hours = accepted_hours(questions, answers).where("topic IS NOT NULL").groupBy("topic").agg(F.avg("hours").alias("avg_hours"))
    shares = questions.where("topic IS NOT NULL").groupBy("topic").agg(F.avg(F.col("accepted_answer_id").isNull().cast("double")).alias("avg_no_accepted_answer"))
    out = hours.join(shares, "topic", "full_outer")
    # Filling with the mean does not change the mean.
    out = out.withColumn("avg_hours", F.coalesce("avg_hours", F.avg("avg_hours").over(_all()), F.lit(1.0)))
    out = out.na.fill(0.0, ["avg_no_accepted_answer"])
    out = out.withColumns({"T_hat": relative("avg_hours"), "P_hat": relative("avg_no_accepted_answer")})
    return out.withColumn("fused_difficulty", (F.col("P_hat") + F.col("T_hat")) / 2)


def fused(popular: DataFrame, difficult: DataFrame) -> DataFrame:
    """Both sides on topic; a topic that one side lacks stays."""
    return popular.join(difficult, "topic", "full_outer")


def quadrants(both: DataFrame) -> DataFrame:
    """topic, fused values, and the quadrant that the means of both cut."""
    p, d = F.avg("fused_popularity").over(_all()), F.avg("fused_difficulty").over(_all())
    side = lambda c, m, name: F.when(F.col(c) >= m, F.lit(f"high {name}")).otherwise(F.lit(f"low {name}"))
    known = both.where("fused_popularity IS NOT NULL AND fused_difficulty IS NOT NULL")
    return known.select("topic", "fused_popularity", "fused_difficulty", F.concat_ws(", ", side("fused_popularity", p, "popularity"), side("fused_difficulty", d, "difficulty")).alias("quadrant"))
