"""Threads: a question, its answers, and the comments on both, as rows of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import qualified_id
from ..functions.values import number_or_zero, timestamp_or_null


def of_type(posts: DataFrame, *types: str) -> DataFrame:
    """Posts of the given types (question, answer, comment); a post without a type is none of them."""
    return posts.where(F.col("type").isin(*types))


def answers_of(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers whose parent is one of the questions (site, id).

    The ids of the questions are hashed and answers pass by, so that none are ordered.
    """
    return answers.join(questions.select("site", F.col("id").alias("parent_id")).hint("shuffle_hash"), ["site", "parent_id"], "left_semi")


def _links(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """site, post_id, root_id: each question with itself, and its answers with it."""
    own = questions.select("site", F.col("id").alias("post_id"), F.col("id").alias("root_id"))
    return own.unionByName(answers.select("site", F.col("id").alias("post_id"), F.col("parent_id").alias("root_id")))


def _one_root(links: DataFrame) -> DataFrame:
    """Each post of the links once; one that is both (it cannot be, by id) counts as the question."""
    rank = F.when(F.col("root_id") == F.col("post_id"), 0).otherwise(1).alias("rank")
    first = F.min(F.struct(rank, "root_id")).alias("first")
    return links.groupBy("site", "post_id").agg(first).select("site", "post_id", F.col("first.root_id").alias("root_id"))


def tracked_posts(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """site, post_id, root_id: the questions and their answers, each with its question.

    A post that is both (it cannot be, by id) would count as the question.
    """
    return _one_root(_links(questions, answers))


def comments_on(comments: DataFrame, tracked: DataFrame) -> DataFrame:
    """Comments on tracked posts, with the question of their thread."""
    return comments.join(tracked, ["site", "post_id"])


def thread_comments(questions: DataFrame, answers: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments on the questions and on these answers of theirs, with the question of their thread.

    Posts without comments are left out by their ids before the others are
    grouped and hashed; comments pass by.
    """
    commented = comment_counts(comments).select("site", "post_id").hint("shuffle_hash")
    links = _links(questions, answers).join(commented, ["site", "post_id"])
    return comments_on(comments, _one_root(links).hint("shuffle_hash"))


def comment_counts(comments: DataFrame) -> DataFrame:
    """site, post_id, comment_count, summed before any join."""
    return comments.groupBy("site", "post_id").agg(F.count(F.lit(1)).alias("comment_count"))


def with_comment_count(posts: DataFrame, counts: DataFrame) -> DataFrame:
    """Posts (site, id) with their comment_count, 0 for none."""
    named = counts.withColumnRenamed("post_id", "id").hint("shuffle_hash")  # posts pass by, none are ordered
    return posts.join(named, ["site", "id"], "left").na.fill(0, ["comment_count"])


def unified_posts(questions: DataFrame, answers: DataFrame, comments: DataFrame, sites: DataFrame) -> DataFrame:
    """All posts of the threads of ``questions``, in the columns of schema.THREAD_POSTS.

    questions, answers: site (alias), id, parent_id, accepted_answer_id, tags
    (array), title, body, score, view_count, answer_count, creation_date,
    last_activity_date, last_edit_date, owner_id, as text or typed.
    comments: site, id, post_id, owner_id, score, text, creation_date.
    sites: site, archive.
    """
    answers = answers_of(questions, answers)
    counts = comment_counts(comments)  # those of other posts meet none below
    q, a = (with_comment_count(_typed(_dated(posts)), counts) for posts in (questions, answers))
    return _unified(q, a, _typed(thread_comments(questions, answers, _dated(comments))), sites)


def rooted(questions: DataFrame, answers: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, answers and comments, each with root_id, its question's id; answers and comments of other threads are left out.

    Kept in buckets by (site, root_id) (tables.write_bucketed), all posts of a
    thread lie in one bucket, and unified_from_rooted() exchanges nothing.
    """
    answers = answers_of(questions, answers)
    placed = thread_comments(questions, answers, comments)
    return questions.withColumn("root_id", F.col("id")), answers.withColumn("root_id", F.col("parent_id")), placed


def unified_from_rooted(questions: DataFrame, answers: DataFrame, comments: DataFrame, sites: DataFrame) -> DataFrame:
    """unified_posts() of what rooted() gives, for all or some of its questions, by joins and groups on (site, root_id) alone."""
    thread = ["site", "root_id"]
    own = questions.select(thread)
    answers, comments = answers.join(own, thread, "left_semi"), comments.join(own, thread, "left_semi")
    # Comments are counted for each post of a thread; the counts of a thread travel as one map.
    each = comments.groupBy(*thread, "post_id").agg(F.count(F.lit(1)).alias("n"))
    counts = each.groupBy(*thread).agg(F.map_from_entries(F.collect_list(F.struct("post_id", "n"))).alias("_counts"))
    counted = lambda posts: posts.join(counts, thread, "left").withColumn("comment_count", F.coalesce(F.try_element_at("_counts", F.col("id")), F.lit(0))).drop("_counts")
    return _unified(*[_typed(_dated(posts)) for posts in (counted(questions), counted(answers), comments)], sites)


def _dated(posts: DataFrame) -> DataFrame:
    """Posts with dates for texts and with sorted tags, as far as they have these columns; an exchange then carries fewer bytes."""
    made = {c: timestamp_or_null(F.col(c).cast("string")) for c in ("creation_date", "last_activity_date", "last_edit_date")}
    made |= {"tags": F.array_sort(F.array_distinct("tags")), "owner_id": F.col("owner_id").cast("string")}
    return posts.withColumns({c: v for c, v in made.items() if c in posts.columns})


def _typed(dated: DataFrame) -> DataFrame:
    """Posts with numbers for texts, too; a number beyond a bigint fails, so only posts of threads come here."""
    return dated.withColumns({c: number_or_zero(F.col(c)).cast("bigint") for c in ("score", "view_count", "answer_count") if c in dated.columns})


def _unified(questions: DataFrame, answers: DataFrame, comments: DataFrame, sites: DataFrame) -> DataFrame:
    """The rows of three kinds of posts, _typed(), in the columns of schema.THREAD_POSTS."""
    alias = F.col("site")
    no_text, no_number, no_time = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("timestamp")

    def common(type_: str) -> dict:
        return {"site_alias": alias, "creation_date": F.col("creation_date"), "owner_id": F.col("owner_id"), "score": F.col("score"), "id": qualified_id(alias, F.col("id")), "type": F.lit(type_)}

    dates = {c: F.col(c) for c in ("last_activity_date", "last_edit_date")}
    q = common("question") | dates | {
        "tags": F.col("tags"), "question_id": qualified_id(alias, F.col("id")), "accepted_answer_id": qualified_id(alias, F.col("accepted_answer_id")),
        "answer_count": F.col("answer_count"), "view_count": F.col("view_count"), "comment_count": F.col("comment_count"), "title": F.col("title"), "body": F.col("body"),
    }
    a = common("answer") | dates | {
        "tags": F.array().cast("array<string>"), "question_id": qualified_id(alias, F.col("parent_id")), "accepted_answer_id": no_text,
        "answer_count": no_number, "view_count": no_number, "comment_count": F.col("comment_count"), "title": no_text, "body": F.col("body"),
    }
    c = common("comment") | {
        "last_activity_date": no_time, "last_edit_date": no_time, "tags": F.array().cast("array<string>"), "question_id": qualified_id(alias, F.col("root_id")), "accepted_answer_id": no_text,
        "answer_count": no_number, "view_count": no_number, "comment_count": no_number, "title": no_text, "body": F.col("text"),
    }
    parts = [df.select(*[v.alias(k) for k, v in columns.items()]) for df, columns in ((questions, q), (answers, a), (comments, c))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    order = ["site_alias", "tags", "question_id", "accepted_answer_id", "answer_count", "creation_date", "last_activity_date", "last_edit_date", "owner_id", "score", "view_count", "comment_count", "title", "body", "site", "id", "type"]
    archives = F.broadcast(sites.select(F.col("site").alias("site_alias"), F.col("archive").alias("site")))  # a row a site
    return out.join(archives, "site_alias", "left").select(order)
