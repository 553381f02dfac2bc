import json

import pytest
from pyspark.sql import functions as F

from threadlens.config import Site
from threadlens.plans import mining
from threadlens.sources import dumps, tables
from threadlens.streaming import incremental

POSTS = """<?xml version="1.0" encoding="utf-8"?>
<posts>
  <row Id="1" PostTypeId="1" AcceptedAnswerId="3" CreationDate="2020-01-01T00:00:00.000" Score="5" ViewCount="100" Body="&lt;p&gt;How do keys work? &lt;code&gt;x()&lt;/code&gt;&lt;/p&gt;" OwnerUserId="10" Title="Keys" Tags="&lt;crypto&gt;&lt;keys&gt;" AnswerCount="2" />
  <row Id="2" PostTypeId="1" CreationDate="2020-02-01T00:00:00.000" Score="1" ViewCount="5" Body="b" OwnerUserId="11" Title="Own" Tags="|crypto|keys|" AnswerCount="1" />
  <row Id="3" PostTypeId="2" ParentId="1" CreationDate="2020-01-02T00:00:00.000" Score="2" Body="They open locks." OwnerUserId="12" />
  <row Id="4" PostTypeId="2" ParentId="1" CreationDate="2020-01-03T00:00:00.000" Body="Line one&#xA;line two" />
  <row Id="5" PostTypeId="2" ParentId="2" CreationDate="2020-02-02T00:00:00.000" Body="mine" OwnerUserId="11" />
  <row Id="6" PostTypeId="1" CreationDate="2020-03-01T00:00:00.000" Body="b" Title="Other" Tags="&lt;cooking&gt;" AnswerCount="0" />
  <row Id="7" PostTypeId="1" CreationDate="2020-03-01T00:00:00.000" Body="no tags" Title="None" Tags="" />
  <row Id="8" PostTypeId="5" Body="wiki" />
</posts>"""
COMMENTS = """<?xml version="1.0" encoding="utf-8"?>
<comments>
  <row Id="1" PostId="1" Score="0" Text="nice" CreationDate="2020-01-05T00:00:00.000" UserId="9" />
  <row Id="2" PostId="3" Text="thanks" CreationDate="2020-01-06T00:00:00.000" />
  <row Id="3" PostId="404" Text="lost" CreationDate="2020-01-06T00:00:00.000" />
  <row Id="4" PostId="8" Text="on the wiki" CreationDate="2020-01-06T00:00:00.000" />
</comments>"""
SITES = (Site("crypto", "crypto.example.7z", ("crypto",), 0.1, 0.1, ("denied",)), Site("gone", "gone.example.7z", ("crypto",), 0.1, 0.1))


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    root = tmp_path_factory.mktemp("dump")
    (root / "crypto.example").mkdir()
    (root / "crypto.example/Posts.xml").write_text(POSTS)
    (root / "crypto.example/Comments.xml").write_text(COMMENTS)
    return str(root)


def test_read_posts(spark, dump):
    got = {r.id: r for r in dumps.read_posts(spark, dump, SITES).collect()}
    assert len(got) == 8 and got["1"].tags == ["crypto", "keys"] == got["2"].tags and got["7"].tags == [] and got["7"].raw_tags is None
    assert got["1"].body == "<p>How do keys work? <code>x()</code></p>" and got["4"].owner_id is None and got["4"].body == "Line one\nline two"
    assert dumps.questions(dumps.read_posts(spark, dump, SITES)).count() == 3


def test_mining(spark, dump):
    mined = mining.mine(spark, dump, SITES)
    assert {r.site: (r.questions, r.answers, r.comments) for r in mined.census.collect()} == {"crypto": (4, 3, 3), "gone": (0, 0, 0), "TOTAL": (4, 3, 3)}
    assert sorted((r.question_id, r.tags) for r in mined.coarse.collect()) == [("1", "crypto;keys"), ("2", "crypto;keys")]
    assert {r.tag: (r.b, r.a, r.h1, r.h2) for r in mined.related.collect()} == {"crypto": (2, 2, 1.0, 1.0), "keys": (2, 2, 1.0, 1.0)}
    assert {(r.type, r.id) for r in mined.threads.collect()} == {("question", "crypto:1"), ("question", "crypto:2"), ("answer", "crypto:3"), ("answer", "crypto:4"), ("answer", "crypto:5"), ("comment", "crypto:1"), ("comment", "crypto:2")}
    # The second question was answered by its asker only.
    assert {r.question_id for r in mined.popular.collect()} == {"crypto:1"} and mined.popular.count() == 5
    normal = {(r.type, r.id): r.normalized_text for r in mining.normalise(mined.threads).collect()}
    assert normal["question", "crypto:1"] == "key key" and normal["answer", "crypto:3"] == "open lock" and "title" not in mining.normalise(mined.threads).columns


def test_missing_dumps_are_empty(spark, tmp_path):
    mined = mining.mine(spark, str(tmp_path), SITES)
    assert mined.popular.collect() == [] and mined.threads.collect() == []
    assert {r.site: r.questions for r in mined.census.collect()} == {"crypto": 0, "gone": 0, "TOTAL": 0}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted"\nline, with comma', ["x", "y"]), (2, None, [])], "i int, t string, l array<string>")
    tables.write_csv(df, f"{tmp_path}/c")
    back = {r.i: (r.t, r.l) for r in tables.read_csv(spark, f"{tmp_path}/c", "i int, t string, l string").collect()}
    assert back == {1: ('a "quoted"\nline, with comma', "x;y"), 2: (None, None)}
    again = tables.write_stage(df, f"{tmp_path}/p")
    assert sorted(again.collect()) == sorted(df.collect()) and again.schema == df.schema
    tables.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "o int, line string"), f"{tmp_path}/r", "o")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()] == ["a", "b"]
    tables.write_sheet(df.select("i", "t"), f"{tmp_path}/s")
    assert tables.read_sheet(spark, f"{tmp_path}/s").count() == 2
    with pytest.raises((RuntimeError, OSError)):
        tables.read_sheet(spark, f"{tmp_path}/none.xlsx")


def test_topic_names(spark, tmp_path):
    rows = [{"topics": [{"topic_index": 0, "topic_name": "a", "justification": "j"}, {"topic_index": 1, "topic_name": "b"}]}, {"topics": [{"topic_id": 0, "inferred_name": "c", "rationale": "r"}]}]
    for name, row in zip(("main", "t0"), rows):
        (tmp_path / f"topic_inference_{name}.json").write_text(json.dumps(row, indent=1))
    read = lambda m: {r.topic_index: r.topic_name for r in tables.read_topic_names_or_default(spark, str(tmp_path), m).collect()}
    assert read("main") == {0: "a", 1: "b"} and read("t0") == {0: "c"} and read("t9") == {}
    (tmp_path / "meta.json").write_text('{"num_topics": 21, "alpha": 2.38, "perplexity": 500.5}')
    meta = tables.read_model_meta(spark, f"{tmp_path}/meta.json").first()
    assert (meta.num_topics, meta.coherence, meta.perplexity) == (21, None, 500.5)


def test_streams(spark, tmp_path):
    rows = [("2020-01-01 10:00:00", "s", ["a", "b"], "1", "t"), ("2020-01-01 11:00:00", "s", ["b"], "1", "t"), ("2020-01-02 10:00:00", "s", ["a"], "2", "u"), ("2020-03-01 10:00:00", "s", ["z"], "1", "u")]
    df = spark.createDataFrame(rows, "at string, site string, tags array<string>, post_type string, topic string").withColumn("creation_date", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    for k, (make, want) in enumerate((
        (lambda s: incremental.tag_counts_stream(s, "a"), {("s", "a", 1, 1), ("s", "b", 2, 1)}),
        (lambda s: incremental.census_stream(s), {("s", 2, 0), ("s", 0, 1)}),
        (lambda s: incremental.trend_stream(s), {("t", 2), ("u", 1)}),
    )):
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = make(stream).writeStream.format("memory").queryName(f"out{k}").outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        assert want <= {tuple(r)[1:] for r in spark.table(f"out{k}").collect()}


def test_csv_batches_append(spark, tmp_path):
    path = str(tmp_path / "rows")
    for part in ([(1, 'a "q",\nb', None)], [(2, "c", "d")]):
        tables.append_csv(spark.createDataFrame(part, "id int, body string, x string"), path)
    assert sorted(map(tuple, tables.read_csv(spark, path, "id int, body string, x string").collect())) == [(1, 'a "q",\nb', None), (2, "c", "d")]
