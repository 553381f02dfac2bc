"""Which tags belong to an anchor's subject.

b counts questions with a tag, a those that also have the anchor;
h1 = a / b, h2 = a / (questions with the anchor).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import GRID_1, GRID_2
from ..functions.tags import threshold_label


def anchored_questions(questions: DataFrame, anchors: Iterable[str]) -> DataFrame:
    """Questions that have any of the anchor tags (column tags: array)."""
    return questions.where(F.arrays_overlap("tags", F.array(*[F.lit(a) for a in anchors])))


def coarse_questions(questions: DataFrame, anchors: Iterable[str]) -> DataFrame:
    """site, tags (joined in their order), question_id of the anchored questions."""
    return anchored_questions(questions, anchors).select("site", F.array_join("tags", ";").alias("tags"), F.col("id").cast("string").alias("question_id"))


def related_questions(questions: DataFrame, related: DataFrame) -> DataFrame:
    """Questions with at least one of their site's related tags (site, tag)."""
    hits = questions.select("site", "id", F.explode("tags").alias("tag")).join(related.select("site", "tag"), ["site", "tag"], "left_semi")
    return questions.join(hits.select("site", "id").distinct(), ["site", "id"], "left_semi")


def tag_counts(questions: DataFrame, anchor: str, by_site: bool = True) -> DataFrame:
    """site, tag, b, a: occurrences over all questions, and over those with the anchor."""
    tags = questions.where(F.size("tags") > 0).select("site", F.array_contains("tags", anchor).alias("anchored"), F.explode("tags").alias("tag"))
    keys = ["site", "tag"] if by_site else ["tag"]
    return tags.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"), F.count_if("anchored").alias("a"))


def metrics(counts: DataFrame, anchor: str) -> DataFrame:
    """Adds h1 and h2 to tag_counts(); tags that never meet the anchor go, and all do without the anchor.

    The anchor's own row is joined back by site: one small row a site.
    """
    keys = [c for c in ("site",) if c in counts.columns]
    anchors = counts.where((F.col("tag") == anchor) & (F.col("a") > 0)).select(*keys, F.col("a").alias("c"))
    joined = counts.join(anchors, keys) if keys else counts.crossJoin(anchors)
    return joined.where("a > 0").select(*keys, "tag", "b", "a", (F.col("a") / F.col("b")).alias("h1"), (F.col("a") / F.col("c")).alias("h2"))


def tag_metrics(questions: DataFrame, anchor: str, by_site: bool = True) -> DataFrame:
    return metrics(tag_counts(questions, anchor, by_site), anchor)


def above_thresholds(df: DataFrame, threshold_1: float | None, threshold_2: float | None) -> DataFrame:
    """Tags at or above each threshold that is given."""
    for column, threshold in (("h1", threshold_1), ("h2", threshold_2)):
        if threshold is not None:
            df = df.where(F.col(column) >= threshold)
    return df


def removal_tallies(df: DataFrame, threshold_1: float, threshold_2: float) -> DataFrame:
    """How many tags fall below the first threshold, the second, and both."""
    low_1, low_2 = F.col("h1") < threshold_1, F.col("h2") < threshold_2
    return df.agg(F.count_if(low_1 & ~low_2).alias("by_h1"), F.count_if(~low_1 & low_2).alias("by_h2"), F.count_if(low_1 & low_2).alias("by_both"))


def without_denied(df: DataFrame, denied: DataFrame) -> DataFrame:
    """Drops the (site, tag) pairs of ``denied``."""
    return df.join(denied.select("site", "tag"), ["site", "tag"], "left_anti")


def grid(spark, grid_1=GRID_1, grid_2=GRID_2) -> DataFrame:
    """combination, threshold_1, threshold_2: all points, as many as the two lists make."""
    rows = [(a, b) for a in grid_1 for b in grid_2]
    points = spark.createDataFrame(rows, "threshold_1 double, threshold_2 double")
    return points.select(threshold_label(F.col("threshold_1"), F.col("threshold_2")).alias("combination"), "threshold_1", "threshold_2")


def sweep(df: DataFrame, points: DataFrame) -> DataFrame:
    """combination, threshold_1, threshold_2, num_tags, tags for every point of the grid.

    ``df`` has one row a tag and the grid a few dozen points.  Each tag is
    paired with the points it passes; points that none passes have 0 tags.
    """
    passed = df.select("tag", "h1", "h2").join(F.broadcast(points), (F.col("h1") >= F.col("threshold_1")) & (F.col("h2") >= F.col("threshold_2")))
    tags = passed.groupBy("combination").agg(F.count(F.lit(1)).alias("num_tags"), F.array_sort(F.collect_list("tag")).alias("tags"))
    return points.join(tags, "combination", "left").select("combination", "threshold_1", "threshold_2", F.coalesce("num_tags", F.lit(0)).alias("num_tags"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def sweep_extremes(swept: DataFrame) -> DataFrame:
    """The points with fewest, upper-median and most tags; ties go by name, so fewest takes the first and most the last."""
    order = Window.orderBy("num_tags", "combination")
    ranked = swept.select("combination", "num_tags", F.row_number().over(order).alias("r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    which = F.when(F.col("r") == 1, F.array(F.lit("fewest"))).otherwise(F.array().cast("array<string>"))
    which = F.concat(which, F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.array(F.lit("median"))).otherwise(F.array().cast("array<string>")))
    which = F.concat(which, F.when(F.col("r") == F.col("n"), F.array(F.lit("most"))).otherwise(F.array().cast("array<string>")))
    return ranked.select(F.explode(which).alias("extreme"), "combination", "num_tags")


def sweep_summary(swept: DataFrame) -> DataFrame:
    """Points by falling number of tags."""
    return swept.select("combination", "threshold_1", "threshold_2", "num_tags").orderBy(F.col("num_tags").desc(), "combination")


def sweep_wide(swept: DataFrame, combinations: list[str]) -> DataFrame:
    """pos and a column a point (dots of its name as underscores): its tags in order, '' beyond their end."""
    names = [c.replace(".", "_") for c in combinations]
    rows = swept.select(F.replace("combination", F.lit("."), F.lit("_")).alias("combination"), F.posexplode("tags").alias("pos", "tag"))
    return rows.groupBy("pos").pivot("combination", names).agg(F.first("tag")).na.fill("", names)


def shared_tags(tags: DataFrame, other: DataFrame) -> DataFrame:
    """site, tag of the pairs that both frames have, each once; null equals null."""
    return tags.select("site", "tag").intersect(other.select("site", "tag"))
