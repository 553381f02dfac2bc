"""Quality of threads: no thread answered only by its asker, and only the popular ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import POPULARITY_QUANTILE
from ..functions.values import number_or_zero
from ..lineage import cut
from ..schema import require

METRICS = ("answer_count", "view_count", "score", "comment_count")
#: Decimals to which metrics and quantiles are compared, beyond the noise of interpolation.
DECIMALS = 6
#: Wanted ranks (two for each site and metric) up to which they are broadcast.
SMALL_RANKS = 100_000


def numeric_metrics(posts: DataFrame, metrics=METRICS) -> DataFrame:
    """Metrics as doubles: 0 for null, missing columns and texts that are no number."""
    return posts.withColumns({c: number_or_zero(F.col(c)) if c in posts.columns else F.lit(0.0) for c in metrics})


def without_repeats(posts: DataFrame) -> DataFrame:
    """Drops rows that repeat another in every column; nulls equal nulls.

    Rows are dealt out before they are compared: most are unlike, and a table of
    all rows of an input split, built before the exchange, would save nothing and
    take memory with the split.  As many parts as the session shuffles into are
    kept, since the planner would merge small ones into large tables again.
    """
    parts = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return posts.repartition(parts, *[F.col(f"`{c}`") for c in posts.columns]).dropDuplicates()


def has_owner(column: str = "owner_id"):
    return F.col(column).isNotNull() & (F.col(column) != "")


def considered_questions(posts: DataFrame) -> DataFrame:
    """Questions with an owner and at least one answer by their own count."""
    return posts.where((F.col("type") == "question") & has_owner() & (F.col("answer_count") > 0))


def threads_of(posts: DataFrame, questions: DataFrame) -> DataFrame:
    """All posts of the threads of ``questions``.

    The ids of the questions are hashed and posts pass by; ordering both for a
    merge would take memory with all posts of a part.
    """
    return posts.join(questions.select("question_id").hint("shuffle_hash"), "question_id", "left_semi")


def skipped_threads(posts: DataFrame) -> DataFrame:
    """Posts of threads whose question has no owner; they stay without a test."""
    return threads_of(posts, posts.where((F.col("type") == "question") & ~has_owner()))


def question_answers(posts: DataFrame) -> DataFrame:
    """question_id, site_alias, owner_q, owner_a, and answer_id if posts have ids: considered questions with their answers."""
    require(posts, "question_id", "site_alias", "type", "owner_id", answer_count="number")
    asked = considered_questions(posts).select("question_id", "site_alias", F.col("owner_id").alias("owner_q"))
    ids = [F.col("id").alias("answer_id")] if "id" in posts.columns else []
    return asked.join(posts.where("type = 'answer'").select("question_id", F.col("owner_id").alias("owner_a"), *ids), "question_id")


def answer_stats(posts: DataFrame) -> DataFrame:
    """question_id, site_alias, total_answers, self_answers of considered questions that have answer rows."""
    own = F.coalesce(has_owner("owner_a") & (F.col("owner_q") == F.col("owner_a")), F.lit(False))
    return question_answers(posts).groupBy("question_id", "site_alias").agg(F.count(F.lit(1)).alias("total_answers"), F.count_if(own).alias("self_answers"))


def self_answered(stats: DataFrame) -> DataFrame:
    """Questions all of whose answers come from the asker."""
    return stats.where("self_answers > 0 AND self_answers = total_answers")


def self_answered_by_site(answered: DataFrame, examples: int = 3) -> DataFrame:
    """site_alias, num_questions, num_self_answers, and the first few question ids.

    Ranks are bounded before questions are dealt by site, so no task orders a whole site.
    """
    first = Window.partitionBy("site_alias").orderBy("question_id")
    counts = answered.groupBy("site_alias").agg(F.count(F.lit(1)).alias("num_questions"), F.sum("total_answers").alias("num_self_answers"))
    ranked = answered.select("site_alias", "question_id", F.row_number().over(first).alias("r")).where(F.col("r") <= examples)
    shown = ranked.groupBy(F.col("site_alias").alias("_site")).agg(F.array_sort(F.collect_list("question_id")).alias("examples"))
    return counts.join(shown, F.col("site_alias").eqNullSafe(F.col("_site"))).drop("_site")


def without_threads(posts: DataFrame, questions: DataFrame) -> DataFrame:
    """Drops whole threads."""
    return posts.join(questions.select("question_id"), "question_id", "left_anti")


#: Parts that a range of values is split into by one pass of the selection.
BINS = 1 << 12


def quantiles(questions: DataFrame, q: float = POPULARITY_QUANTILE, metrics=METRICS, key: str = "site_alias", bins: int = BINS) -> DataFrame:
    """Exact interpolated quantile of each metric by site.

    The two values beside the quantile's place are selected by rank: each pass
    counts the values of a range in equal parts and goes on with the part that
    holds the rank, until that has one value.  Nothing is ordered but the counts
    of the parts, so no task depends on the size of a site.  Nulls and NaN are
    left out; rows of a null site form no group.
    """
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    values = questions.where(F.col(key).isNotNull()).select(F.col(key).alias("site"), F.inline(listed)).where("value IS NOT NULL AND NOT isnan(value)")
    values = cut(values.groupBy("site", "metric", "value").agg(F.count(F.lit(1)).alias("n")))
    ranges = values.groupBy("site", "metric").agg(F.min("value").alias("low"), F.max("value").alias("high"), ((F.sum("n") - 1) * F.lit(q)).alias("at"))
    ends = F.array(*[F.struct(F.lit(w).alias("which"), f("at").cast("bigint").alias("rank")) for w, f in (("low", F.floor), ("high", F.ceil))])
    open_ = cut(ranges.withColumn("e", F.explode(ends)).select("site", "metric", "low", "high", "at", "e.which", "e.rank"))
    found = []
    while True:
        found.append(open_.where("low = high").select("site", "metric", "at", "which", F.col("low").alias("value")))
        open_ = open_.where("low < high")
        wanted = open_.count()
        if not wanted:
            break
        open_ = cut(_narrowed(values, F.broadcast(open_) if wanted <= SMALL_RANKS else open_, bins))
    chosen = found[0]
    for more in found[1:]:
        chosen = chosen.unionByName(more)
    sides = chosen.groupBy("site", "metric", "at").agg(*[F.max(F.when(F.col("which") == w, F.col("value"))).alias(w) for w in ("low", "high")])
    between = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    wide = sides.select(F.col("site").alias(key), "metric", F.round(between, DECIMALS).alias("v")).groupBy(key).pivot("metric", list(metrics)).agg(F.first("v"))
    return wide.select(key, *[F.col(m).alias(f"q_{m}") for m in metrics])


def _narrowed(values: DataFrame, wanted: DataFrame, bins: int) -> DataFrame:
    """Each wanted rank with the least and largest value of the part that holds it; ranks count from that part's start."""
    inside = values.join(wanted, ["site", "metric"]).where(F.col("value").between(F.col("low"), F.col("high")))
    # Quarters of bounded values, so that the width of a range can't overflow; both ends have parts of their own, so every pass narrows.
    quarter = lambda c: F.greatest(F.least(F.col(c), F.lit(1.7e308)), F.lit(-1.7e308)) / 4
    place = F.coalesce(F.floor(F.try_divide(quarter("value") - quarter("low"), quarter("high") - quarter("low")) * bins), F.lit(0))
    part = F.when(F.col("value") == F.col("low"), F.lit(-1)).when(F.col("value") == F.col("high"), F.lit(bins + 1)).otherwise(place)
    of = ["site", "metric", "at", "which", "rank"]
    parts = inside.groupBy(*of, part.alias("part")).agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    upto = Window.partitionBy("site", "metric", "which").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("upto", F.sum("n").over(upto)).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return parts.select("site", "metric", "low", "high", "at", "which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))


def popular_questions(questions: DataFrame, q: float = POPULARITY_QUANTILE, metrics=METRICS, key: str = "site_alias") -> DataFrame:
    """Questions that reach their site's quantile in every metric."""
    bars = quantiles(questions, q, metrics, key)
    joined = questions.join(bars, key)
    for c in metrics:
        joined = joined.where(F.round(F.col(c).cast("double"), DECIMALS) >= F.col(f"q_{c}"))
    return joined.select(questions.columns)


def popular_threads(posts: DataFrame, q: float = POPULARITY_QUANTILE) -> DataFrame:
    """The whole filter: repeats out, self-answered threads out, then threads of popular questions only.

    Quantiles are taken over the questions that are left by then.  Where
    nothing is left the result is empty.  Whole posts are dealt out for the
    repeats and for the final pick only; all else is worked out on the few
    columns it needs.
    """
    require(posts, "question_id", "site_alias", "owner_id", type="text")
    posts = cut(numeric_metrics(without_repeats(posts)))
    narrow = posts.select("question_id", "site_alias", "type", "owner_id", *METRICS)
    narrow = without_threads(narrow, self_answered(answer_stats(narrow)))
    return threads_of(posts, popular_questions(narrow.where("type = 'question'"), q))
