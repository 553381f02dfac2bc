import shutil

import pytest
from pyspark.sql import functions as F

from threadlens.operators import fused, quality, sampling
from threadlens.sources import tables
from threadlens.sources.observed import StageFailed, standard_tallies, write_observed
from threadlens.streaming.append_once import append_once, committed, read_appended

SCHEMA = "id bigint, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- exactly-once append ---


def test_a_replayed_batch_writes_nothing(spark, tmp_path):
    path, take = f"{tmp_path}/out", append_once(f"{tmp_path}/out")
    assert committed(spark, path) == [] and rows(read_appended(spark, path, SCHEMA)) == []
    first = spark.createDataFrame([(1, 'a "b",\nc'), (2, None), (2, None)], SCHEMA)
    for _ in range(3):
        take(first, 0)
    take(first.limit(0), 1)
    take(spark.createDataFrame([(3, "z")], SCHEMA), 7)
    assert committed(spark, path) == [0, 1, 7]
    assert rows(read_appended(spark, path, SCHEMA)) == sorted([*map(tuple, first.collect()), (3, "z")], key=str)


def test_a_killed_attempt_leaves_nothing_to_readers(spark, tmp_path):
    path, take = f"{tmp_path}/out", append_once(f"{tmp_path}/out")
    broken = spark.range(4, numPartitions=4).select("id", F.when(F.col("id") == 3, F.raise_error(F.lit("killed"))).otherwise(F.lit("x")).alias("text"))
    with pytest.raises(Exception, match="killed"):
        take(broken, 0)
    assert committed(spark, path) == [] and rows(read_appended(spark, path, SCHEMA)) == []
    take(spark.createDataFrame([(1, "x")], SCHEMA), 0)
    assert rows(read_appended(spark, path, SCHEMA)) == [(1, "x")]


def test_a_stream_that_is_killed_after_its_commit_replays_without_repeats(spark, tmp_path):
    source, path, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    spark.range(10).selectExpr("id", "CAST(id AS STRING) AS text").write.parquet(f"{source}/a")
    take = append_once(path)

    def stream(sink):
        read = spark.readStream.schema(SCHEMA).parquet(f"{source}/*")
        return read.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()

    def killed(batch, number):
        take(batch, number)
        raise RuntimeError("killed after the commit")

    with pytest.raises(Exception, match="killed after"):
        stream(killed).awaitTermination()
    assert committed(spark, path) == [0]
    spark.range(10, 15).selectExpr("id", "CAST(id AS STRING) AS text").write.parquet(f"{source}/b")
    stream(take).awaitTermination()
    assert rows(read_appended(spark, path, SCHEMA)) == sorted(((i, str(i)) for i in range(15)), key=str)
    assert len(committed(spark, path)) == 2
    shutil.rmtree(path)


# --- tallies ---


def test_tallies_come_with_the_write(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), (None, " ", 1), ("", None, 2), ("b", "y", None)], "owner_id string, body string, k int")
    jobs = []
    for name, write in (("plain", lambda: tables.write_stage(df, f"{tmp_path}/p")), ("observed", lambda: write_observed(df, f"{tmp_path}/o", standard_tallies(df, unique=["k"])))):
        spark.sparkContext.setJobGroup(name, "")
        out = write()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stage, found = out
    assert jobs[0] == jobs[1] and rows(stage) == rows(df)
    assert found == {"rows": 4, "null_owners": 2, "empty_texts": 2, "about_unique_k": 3}


def test_bounds_fail_a_stage_and_remove_it(spark, tmp_path):
    df = spark.createDataFrame([("a", "x")], "owner_id string, body string")
    assert write_observed(df, f"{tmp_path}/s", bounds={"rows": (1, None), "empty_texts": (None, 0)})[1]["rows"] == 1
    with pytest.raises(StageFailed, match="rows is 0") as e:
        write_observed(df.limit(0), f"{tmp_path}/t", bounds={"rows": (1, None)})
    assert e.value.tallies["rows"] == 0 and not (tmp_path / "t").exists()


# --- buckets ---


def exchanges(df):
    df.collect()
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange")


def test_bucketed_threads_need_no_exchange(spark, tmp_path):
    posts = [(f"s:{q}", "s", "question", f"s:{q}", f"u{q % 3}", 2, f"s:{q}-1" if q % 2 else None, f"t{q % 2}", f"2024-01-01 00:00:{q:02d}") for q in range(30)]
    posts += [(f"s:{q}", "s", "answer", f"s:{q}-{k}", f"u{(q + k) % 3}", None, None, None, f"2024-01-01 0{k}:00:00") for q in range(30) for k in range(1, 4)]
    df = spark.createDataFrame(posts, "question_id string, site_alias string, type string, id string, owner_id string, answer_count int, accepted_answer_id string, topic string, d string").withColumn("creation_date", F.to_timestamp("d")).drop("d")
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = tables.write_bucketed(df, "bucketed_threads", 4, "question_id")
        q, a = (lambda p: p.where("type = 'question'")), (lambda p: p.where("type = 'answer'"))
        for work in (
            lambda p: quality.answer_stats(p),
            lambda p: quality.without_threads(p, quality.self_answered(quality.answer_stats(p))).select("id"),
            lambda p: quality.threads_of(p, quality.considered_questions(p)).select("id"),
            lambda p: fused.accepted_hours(q(p), a(p), thread="question_id"),
        ):
            assert rows(work(kept)) == rows(work(df))
            assert exchanges(work(kept)) == 0 and exchanges(work(df)) > 0
        assert rows(fused.accepted_hours(q(df), a(df))) == rows(fused.accepted_hours(q(df), a(df), thread="question_id"))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
        spark.sql("DROP TABLE IF EXISTS bucketed_threads")


def test_rooted_threads_are_unified_without_an_exchange(spark):
    from threadlens.operators import threads

    text = lambda rows, names: spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"{n} string" for n in names.split()))
    extra = {c: F.lit(None).cast("string") for c in ("score", "view_count", "answer_count", "creation_date", "last_activity_date", "last_edit_date", "owner_id", "title", "body", "text", "accepted_answer_id")}
    q = text([("s", k) for k in range(20)] + [("t", 3)], "site id").withColumns(extra).withColumn("tags", F.array(F.lit("b"), F.lit("a")))
    a = text([("s", 100 + k, k % 25) for k in range(60)] + [("t", 100, 3), ("t", 101, None)], "site id parent_id").withColumns(extra)
    c = text([("s", k, p) for k, p in enumerate([0, 0, 1, 100, 100, 101, 124, 999, None])] + [("t", 1, 3), ("u", 1, 3)], "site id post_id").withColumns(extra)
    sites = spark.createDataFrame([("s", "s.7z"), ("t", "t.7z")], "site string, archive string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    names = ["rooted_q", "rooted_a", "rooted_c"]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = [tables.write_bucketed(df, n, 4, "site", "root_id") for df, n in zip(threads.rooted(q, a, c), names)]
        out = threads.unified_from_rooted(*kept, sites)
        assert rows(out) == rows(threads.unified_posts(q, a, c, sites))
        out.collect()
        assert "Exchange hash" not in str(out._jdf.queryExecution().executedPlan()) and "Exchange range" not in str(out._jdf.queryExecution().executedPlan())
        some = threads.unified_from_rooted(kept[0].where("id < '15'"), kept[1], kept[2], sites)
        assert rows(some) == rows(threads.unified_posts(q.where("id < '15'"), a, c, sites))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


# --- required columns ---


def test_stages_refuse_frames_without_their_columns(spark):
    df = spark.createDataFrame([("t", "x")], "topic string, topic_perc_contrib string")
    with pytest.raises(ValueError, match="not a number"):
        sampling.strata(df)
    with pytest.raises(ValueError, match="missing columns"):
        fused.popularity(df)
    with pytest.raises(ValueError, match="missing columns"):
        quality.answer_stats(df)
