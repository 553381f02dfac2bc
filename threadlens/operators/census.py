"""Counts over whole dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("question", "answer", "comment")


def comments_on_posts(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments whose post (site, post_id) is among the posts, each once."""
    return comments.join(posts.select("site", "post_id"), ["site", "post_id"], "left_semi")


def site_census(posts: DataFrame, comments: DataFrame, sites: DataFrame) -> DataFrame:
    """site, questions, answers, comments for every row of ``sites`` (zeros where nothing is found).

    posts: site, id, post_type ('1' question, '2' answer, others exist).
    comments: site, post_id.  A comment counts if any post of its site has that id.
    """
    by_site = posts.groupBy("site").agg(F.count_if(F.col("post_type") == "1").alias("questions"), F.count_if(F.col("post_type") == "2").alias("answers"))
    known = posts.select("site", F.col("id").alias("post_id"))
    by_comment = comments_on_posts(comments, known).groupBy("site").agg(F.count(F.lit(1)).alias("comments"))
    return sites.select("site").join(by_site, "site", "left").join(by_comment, "site", "left").na.fill(0, ["questions", "answers", "comments"])


def with_total(census: DataFrame, label: str = "site", total: str = "TOTAL") -> DataFrame:
    """Appends a row with the sums of all other columns; each site has one row."""
    sums = census.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in census.dtypes if c != label])
    return census.unionByName(sums.withColumn(label, F.lit(total)).select(census.columns))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def null_owners(posts: DataFrame, *keys: str) -> DataFrame:
    """Posts without an owner, by type, site or both."""
    return counts_by(posts.where(F.col("owner_id").isNull() | (F.col("owner_id") == "")), *keys)


def site_by_type(posts: DataFrame) -> DataFrame:
    """site_alias, question, answer, comment: numbers of posts, 0 where there are none."""
    return posts.groupBy("site_alias").pivot("type", list(TYPES)).count().na.fill(0, list(TYPES))


def empty_texts(df: DataFrame, text: str) -> DataFrame:
    """Rows, and how many have a null or blank text."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(text).isNull() | (F.btrim(text) == "")).alias("n_empty"))


def unique_with_null(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of each column, where null counts as one value."""
    return df.agg(*[(F.countDistinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))).cast("bigint").alias(f"unique_{c}") for c in columns])
