from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import census, quality, threads
from threadlens.schema import THREAD_POSTS, require


def test_unified_posts(spark):
    q = spark.createDataFrame(
        [("s", "1", "2", ["b", "a", "b"], "T", "B", "3", "10", "x", "2020-01-01T00:00:00.500", None, None, "7"), ("s", "9", None, ["a"], None, None, None, None, None, "never", None, None, None)],
        "site string, id string, accepted_answer_id string, tags array<string>, title string, body string, score string, view_count string, answer_count string, creation_date string, last_activity_date string, last_edit_date string, owner_id string",
    )
    a = spark.createDataFrame(
        [("s", "2", "1", "A", "5", "2020-01-02", None, None, "8"), ("s", "3", "77", "of another question", "1", None, None, None, None), ("u", "4", "1", "other site", "1", None, None, None, None)],
        "site string, id string, parent_id string, body string, score string, creation_date string, last_activity_date string, last_edit_date string, owner_id string",
    )
    c = spark.createDataFrame(
        [("s", "1", "1", "on the question", "0", None, "5"), ("s", "2", "2", "on the answer", None, None, None), ("s", "3", "2", "again", None, None, None), ("s", "4", "404", "on nothing", None, None, None)],
        "site string, id string, post_id string, text string, score string, creation_date string, owner_id string",
    )
    sites = spark.createDataFrame([("s", "s.7z")], "site string, archive string")
    got = threads.unified_posts(q, a, c, sites)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in THREAD_POSTS]
    by = {(r.type, r.id): r for r in got.collect()}
    assert set(by) == {("question", "s:1"), ("question", "s:9"), ("answer", "s:2"), ("comment", "s:1"), ("comment", "s:2"), ("comment", "s:3")}
    first = by["question", "s:1"]
    assert first.tags == ["a", "b"] and first.accepted_answer_id == "s:2" and first.comment_count == 1 and first.view_count == 10 and first.answer_count == 0 and first.site == "s.7z"
    assert first.creation_date == datetime(2020, 1, 1, 0, 0, 0, 500_000)
    assert by["question", "s:9"].accepted_answer_id is None and by["question", "s:9"].score == 0 and by["question", "s:9"].creation_date is None
    assert by["answer", "s:2"].comment_count == 2 and by["answer", "s:2"].question_id == "s:1"
    assert by["comment", "s:2"].question_id == "s:1" and by["comment", "s:2"].comment_count is None


POSTS = "site_alias string, question_id string, id string, type string, owner_id string, answer_count double, view_count double, score double, comment_count double"


def post(qid, kind, owner, answers=None, metric=None):
    answers, metric = (None if x is None else float(x) for x in (answers, metric))
    return ("s", qid, f"{qid}-{kind}-{owner}", kind, owner, answers, metric, metric, metric)


@pytest.fixture
def posts(spark):
    rows = [
        post("all", "question", "1", 2, 9), post("all", "answer", "1"), post("all", "answer", "1"),
        post("one", "question", "2", 2, 9), post("one", "answer", "2"), post("one", "answer", "3"),
        post("ghost", "question", "4", 1, 9), post("ghost", "answer", None),
        post("anon", "question", None, 1, 9), post("anon", "answer", "5"),
        post("zero", "question", "6", 0, 9), post("zero", "answer", "6"), post("zero", "comment", "6"),
        post("bare", "question", "7", 3, 1),
    ]
    return spark.createDataFrame(rows + [rows[1]], POSTS)


def test_self_answers(posts):
    stats = {r.question_id: (r.total_answers, r.self_answers) for r in quality.answer_stats(quality.without_repeats(posts)).collect()}
    # The two equal answers of 'all' are one row; a null owner is nobody's self; a count of 0 answers is not tested.
    assert stats == {"all": (1, 1), "one": (2, 1), "ghost": (1, 0)}
    answered = quality.self_answered(quality.answer_stats(posts))
    assert [r.question_id for r in answered.collect()] == ["all"]
    site = quality.self_answered_by_site(answered).first()
    assert (site.num_questions, site.num_self_answers, site.examples) == (1, 3, ["all"])
    assert {r.question_id for r in quality.skipped_threads(posts).collect()} == {"anon"}
    pivot = census.site_by_type(posts).first()
    assert (pivot.question, pivot.answer, pivot.comment) == (6, 8, 1)


def test_popular_threads_are_whole(spark, posts):
    got = quality.popular_threads(posts, 0.0).collect()
    assert {r.question_id for r in got} == {"one", "ghost", "anon", "zero", "bare"}
    kept = quality.popular_threads(posts).collect()
    # Three quarters of the five questions left have metrics of 9 and at most 2 answers.
    assert {r.question_id for r in kept} == {"one"}
    assert len([r for r in kept if r.type == "answer"]) == 2
    assert quality.popular_threads(spark.createDataFrame([], POSTS)).collect() == []


def test_quantiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 5.0)], "site_alias string, score double")
    got = {r.site_alias: r.q_score for r in quality.quantiles(df, metrics=("score",)).collect()}
    assert got == {"a": 3.25, "b": 5.0}


def test_numeric_metrics(spark):
    df = spark.createDataFrame([("3",), ("x",), ("",), (None,), (" 2.5 ",), ("nan",)], "score string")
    assert [r.score for r in quality.numeric_metrics(df, ("score", "gone")).collect()] == [3.0, 0.0, 0.0, 0.0, 2.5, 0.0]


def test_census(spark):
    p = spark.createDataFrame([("s", "1", "1"), ("s", "2", "2"), ("s", "3", "5"), ("t", "1", "1")], "site string, id string, post_type string")
    c = spark.createDataFrame([("s", "3"), ("s", "9"), ("t", "1"), ("t", "2")], "site string, post_id string")
    sites = spark.createDataFrame([("s",), ("t",), ("missing",)], "site string")
    got = {r.site: (r.questions, r.answers, r.comments) for r in census.with_total(census.site_census(p, c, sites)).collect()}
    assert got == {"s": (1, 1, 1), "t": (1, 0, 1), "missing": (0, 0, 0), "TOTAL": (2, 1, 2)}


def test_require(spark):
    df = spark.createDataFrame([(1, "a")], "n int, t string")
    assert require(df, "n", t="text") is df
    with pytest.raises(ValueError, match="missing columns: z"):
        require(df, "z")
    with pytest.raises(ValueError, match="t is string, not a number"):
        require(df, t="number")


@pytest.mark.parametrize("bins", [4, 1 << 12])
def test_quantiles_are_selected_exactly(spark, bins):
    """Skewed, tied, tiny, huge and infinite values; a handful of passes, whatever the values."""
    rng = np.random.default_rng(1)
    sets = {
        "even": list(range(100)), "one": [5.0], "same": [2.5] * 40, "two": [1.0] * 30 + [9.0] * 10, "skewed": list(np.exp(rng.normal(0, 30, 400))), "near": list(1.0 + np.arange(50) * 2.0**-52),
        "signs": list(rng.normal(0, 1, 301)), "far": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0], "odd": [3.0, None, float("nan"), 4.0], "none": [None],
    }
    df = spark.createDataFrame([(k, float(v) if v is not None else None) for k, x in sets.items() for v in x] + [(None, 1.0)], "site_alias string, score double").repartition(5)
    for q in (0.0, 0.5, 0.75, 1.0):
        got = {r.site_alias: r.q_score for r in quality.quantiles(df, q, metrics=("score",), bins=bins).collect()}
        assert set(got) == set(sets) - {"none"}
        for k, x in sets.items():
            x = [v for v in x if v is not None and v == v]
            if x and k != "far":
                assert got[k] == pytest.approx(round(float(np.quantile(x, q)), 6), rel=1e-12, abs=1e-6), (k, q)
    ends = spark.createDataFrame([("s", v) for v in (float("-inf"), 1.0, 2.0, float("inf"))], "site_alias string, score double")
    assert quality.quantiles(ends, 2 / 3, metrics=("score",), bins=bins).first().q_score == 2.0


def test_repeats_are_dealt_out_before_they_are_compared(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "b"), (None, None)] * 3, "`x.y` int, v string")
    got = quality.without_repeats(df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, None), (2, "a"), (2, "b"), (None, None)], key=str)
    plan = got._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("ShuffleQueryStage") == 1 and plan.rindex("Aggregate") < plan.index("ShuffleQueryStage")


def test_threads_are_picked_without_ordering_posts(spark, posts):
    """Only ids of questions are held in memory where they are too many to broadcast; no post is ordered."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = quality.skipped_threads(posts)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort" not in plan
        skipped = {r.question_id for r in posts.collect() if r.type == "question" and not r.owner_id}
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in posts.select(got.columns).collect() if r.question_id in skipped)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_unified_posts_deal_answers_out_once_by_thread_and_once_by_id(spark, sf_dir):
    """Where nothing is small enough to broadcast: one exchange serves the answers' groups and their questions, another their comments; no post is ordered for a join."""
    from threadlens.plans import catalog

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["s2_unified_posts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        # Answers: whole and as ids, each by thread and by id; questions: whole, and as ids for either; comments: whole, and counted for each kind.
        assert plan.count("Exchange hashpartitioning") <= 4 + 3 + 1 + 3 * 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_comments_find_one_root_among_repeated_posts(spark):
    """A post that is given twice, or as question and answer, has its comments once, and all its rows have their count."""
    text = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    q = text([("s", "1"), ("s", "1"), ("s", "2"), ("t", "1"), (None, "1"), ("s", None)], "site id")
    a = text([("s", "2", "1"), ("s", "5", "2"), ("s", "5", "1"), ("t", "5", "1"), ("s", "6", "7"), ("s", "8", None), ("s", None, "1")], "site id parent_id")
    c = text([("s", "a", "2"), ("s", "b", "5"), ("s", "b", "5"), ("t", "c", "5"), ("t", "d", "2"), ("s", "e", "6"), ("s", "f", "8"), ("s", "g", None), (None, "h", "1")], "site id post_id")
    got = threads.thread_comments(q, threads.answers_of(q, a), c)
    assert sorted((r.site, r.id, r.root_id) for r in got.collect()) == [("s", "a", "2"), ("s", "b", "1"), ("s", "b", "1"), ("t", "c", "1")]
    counted = threads.with_comment_count(threads.answers_of(q, a), threads.comment_counts(c))
    assert sorted((str(r.site), str(r.id), str(r.parent_id), r.comment_count) for r in counted.collect()) == [("s", "2", "1", 1), ("s", "5", "1", 2), ("s", "5", "2", 2), ("s", "None", "1", 0), ("t", "5", "1", 1)]


def test_numbers_of_posts_outside_the_threads_are_not_read(spark):
    text = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    extra = {c: F.lit(None).cast("string") for c in ("view_count", "answer_count", "creation_date", "last_activity_date", "last_edit_date", "owner_id", "title", "body", "text", "accepted_answer_id")}
    q = text([("s", "1", "2")], "site id score").withColumns(extra).withColumn("tags", F.array(F.lit("a")))
    a = text([("s", "2", "1", "3"), ("s", "3", "9", "1e30")], "site id parent_id score").withColumns(extra)
    c = text([("s", "1", "2", "4"), ("s", "2", "3", "1e30")], "site id post_id score").withColumns(extra)
    got = threads.unified_posts(q, a, c, spark.createDataFrame([("s", "s.7z")], "site string, archive string"))
    assert sorted((r.type, r.score) for r in got.collect()) == [("answer", 3), ("comment", 4), ("question", 2)]
