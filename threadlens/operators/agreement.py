"""Verdicts and agreement of raters on the validation sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHANCE_AGREEMENT, FIRST_PAIR_ROWS
from ..functions.values import is_not_true
from ..schema import require


def invalid_table(sheet: DataFrame) -> DataFrame:
    """topic, invalids, total, difference by topic, most invalid first, and a Total row last.

    A row is invalid unless both verdicts are true; a null verdict is not true.
    """
    require(sheet, "topic", topic_veredict="flag", subtopic_veredict="flag")
    bad = is_not_true(F.col("topic_veredict")) | is_not_true(F.col("subtopic_veredict"))
    table = sheet.where("topic IS NOT NULL").groupBy("topic").agg(F.count_if(bad).alias("invalids"), F.count(F.lit(1)).alias("total"))
    table = table.withColumns({"difference": F.col("total") - F.col("invalids"), "last": F.lit(0)})
    sums = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("invalids", "total", "difference")]).select(F.lit("Total").alias("topic"), "invalids", "total", "difference", F.lit(1).alias("last"))
    return table.unionByName(sums).orderBy("last", F.col("invalids").desc(), "topic").drop("last")


def verdict_means(sheet: DataFrame, *keys: str) -> DataFrame:
    """Share of true verdicts on topic and subtopic, nulls left out, by the keys or overall."""
    require(sheet, *keys, topic_veredict="flag", subtopic_veredict="flag")
    means = [F.avg(F.col(c).cast("int")).alias(f"mean_{c}") for c in ("topic_veredict", "subtopic_veredict")]
    return sheet.groupBy(*keys).agg(*means)


def kappa(sheet: DataFrame, order: str, first: int = FIRST_PAIR_ROWS, chance: float = CHANCE_AGREEMENT) -> DataFrame:
    """pair, n, po_topic, kappa_topic, po_subtopic, kappa_subtopic for the first rows and the rest.

    Chance agreement is fixed.  Two nulls do not agree.  ``order`` holds the
    sheet's row order and is unique.
    """
    require(sheet, order, *(f"{c}_validation_{k}" for c in ("topic", "subtopic") for k in (1, 2)))
    head = sheet.orderBy(order).limit(first).agg(F.max(order).alias("_last"))
    pair = F.when(F.col(order) <= F.col("_last"), F.lit("pair 1")).otherwise(F.lit("pair 2"))
    out = sheet.join(F.broadcast(head)).groupBy(pair.alias("pair")).agg(
        F.count(F.lit(1)).alias("n"),
        *[(F.count_if(F.col(f"{c}_validation_1") == F.col(f"{c}_validation_2")) / F.count(F.lit(1))).alias(f"po_{c}") for c in ("topic", "subtopic")],
    )
    return out.withColumns({f"kappa_{c}": (F.col(f"po_{c}") - chance) / (1 - chance) for c in ("topic", "subtopic")})
