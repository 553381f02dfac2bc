"""Stand-ins for posts, threads and sheets over the order-and-document tables, as frames and as SQL.

Each frame has a SQL twin of the same rows, so that a query and its SQL start
from the same input.
"""

from __future__ import annotations

import glob
import os
import zipfile

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bundled_stopwords() -> frozenset[str] | None:
    """Spark's English stop words as its library file has them, as SQL is written before there is a session; None where that file is not beside pyspark."""
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    if not jars:
        return None
    return frozenset(zipfile.ZipFile(jars[0]).read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split())


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, id, raw, with the two words of a part's name as tags in each of the raw forms in turn."""
    part = table(spark, sf_dir, "part")
    a, b, k = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("<"), a, F.lit("><"), b, F.lit(">")))
        .when(k == 1, F.concat(a, F.lit("; "), b))
        .when(k == 2, F.concat(F.lit("|"), a, F.lit("|"), b, F.lit("|")))
        .otherwise(F.concat(a, F.lit(" "), b))
    )
    return part.select(F.col("p_type").alias("site"), F.col("p_partkey").alias("id"), raw.alias("raw"))


TAGGED = "t AS (SELECT p_type AS site, p_partkey AS id, string_split(p_name, ' ') AS tags FROM part)"
TAGS = f"{TAGGED}, x AS (SELECT site, id, unnest(tags) AS tag, list_contains(tags, 'ring') AS anchored FROM t)"
METRICS = f"""{TAGS},
    c AS (SELECT site, tag, count(*) AS b, count(*) FILTER (WHERE anchored) AS a FROM x GROUP BY site, tag),
    m AS (SELECT c.site, c.tag, c.b, c.a, c.a / c.b AS h1, c.a / r.a AS h2 FROM c JOIN (SELECT site, a FROM c WHERE tag = 'ring' AND a > 0) r USING (site) WHERE c.a > 0)"""


def _line_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.count(F.lit(1)).alias("answer_count"), F.sum("l_quantity").alias("score"), F.round(F.sum("l_extendedprice"), 2).alias("comment_count"))
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, id, owner_id, creation_date, accepted_answer_id, and four metrics, one question an order."""
    o = table(spark, sf_dir, "orders")
    owner = F.when(F.col("o_custkey") % 10 != 0, (F.col("o_custkey") % 10).cast("string"))
    accepted = F.when(F.col("o_orderstatus") != "O", F.concat(F.col("o_orderkey").cast("string"), F.lit("-1")))
    base = o.select(F.col("o_orderpriority").alias("site"), F.col("o_orderkey").alias("id"), owner.alias("owner_id"), F.col("o_orderdate").alias("creation_date"), accepted.alias("accepted_answer_id"), F.col("o_totalprice").alias("view_count"))
    return base.join(_line_sums(spark, sf_dir), "id", "left").na.fill({"answer_count": 0, "score": 0.0, "comment_count": 0.0})


QUESTIONS = """q AS (SELECT o_orderpriority AS site, o_orderkey AS id, CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey % 10 AS VARCHAR) END AS owner_id, o_orderdate AS creation_date,
        CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderkey AS VARCHAR) || '-1' END AS accepted_answer_id, o_totalprice AS view_count,
        coalesce(s.answer_count, 0) AS answer_count, coalesce(s.score, 0) AS score, coalesce(s.comment_count, 0) AS comment_count
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS answer_count, sum(l_quantity) AS score, round(sum(l_extendedprice), 2) AS comment_count FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, id (order-line), parent_id, owner_id, creation_date; the site is that of the order."""
    li = table(spark, sf_dir, "lineitem")
    owner = F.when(F.col("l_suppkey") % 10 != 0, (F.col("l_suppkey") % 10).cast("string"))
    rows = li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").alias("parent_id"), owner.alias("owner_id"), F.col("l_shipdate").alias("creation_date"))
    return rows.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent_id"), F.col("o_orderpriority").alias("site")).hint("shuffle_hash"), "parent_id")


ANSWERS = """a AS (SELECT o_orderpriority AS site, concat(l_orderkey, '-', l_linenumber) AS id, l_orderkey AS parent_id, CASE WHEN l_suppkey % 10 <> 0 THEN CAST(l_suppkey % 10 AS VARCHAR) END AS owner_id,
        l_shipdate AS creation_date FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, post_id (text), owner_id: even events comment on the order of their number, odd ones on its first line."""
    e = table(spark, sf_dir, "events")
    post = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit("-1")))
    return e.select(F.col("event_id").alias("id"), post.alias("post_id"), F.col("user_id").cast("string").alias("owner_id"), F.lit("all").alias("site"))


COMMENTS = "k AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE concat(event_id, '-1') END AS post_id, CAST(user_id AS VARCHAR) AS owner_id FROM events)"


def tracked_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions and answers with text ids on one site, so that comments can meet both."""
    q = questions(spark, sf_dir).where(F.col("answer_count") > 2).select(F.lit("all").alias("site"), F.col("id").cast("string").alias("id"))
    a = answers(spark, sf_dir).select(F.lit("all").alias("site"), "id", F.col("parent_id").cast("string").alias("parent_id")).dropDuplicates()
    return q, a


TRACKED = f"""{QUESTIONS}, {ANSWERS}, {COMMENTS},
    sel AS (SELECT CAST(id AS VARCHAR) AS id FROM q WHERE answer_count > 2),
    ans AS (SELECT DISTINCT id, CAST(parent_id AS VARCHAR) AS parent_id FROM a WHERE CAST(parent_id AS VARCHAR) IN (SELECT id FROM sel)),
    tr AS (SELECT id AS post_id, id AS root_id FROM sel UNION ALL SELECT id, parent_id FROM ans)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_alias, question_id, id, type, owner_id and the four metrics (null where a type has none)."""
    q, a = questions(spark, sf_dir), answers(spark, sf_dir)
    qid = F.col("id").cast("string")
    none = F.lit(None).cast("double")
    metrics = [F.col(c).cast("double").alias(c) for c in ("answer_count", "view_count", "score", "comment_count")]
    rows = q.select(F.col("site").alias("site_alias"), qid.alias("question_id"), qid.alias("id"), F.lit("question").alias("type"), "owner_id", *metrics)
    rows = rows.unionByName(a.select(F.col("site").alias("site_alias"), F.col("parent_id").cast("string").alias("question_id"), "id", F.lit("answer").alias("type"), "owner_id", *[none.alias(c) for c in ("answer_count", "view_count", "score", "comment_count")]))
    c = comments(spark, sf_dir).select(F.split_part("post_id", F.lit("-"), F.lit(1)).alias("question_id"), F.col("id").cast("string").alias("id"), "owner_id")
    sites = q.select(qid.alias("question_id"), F.col("site").alias("site_alias"))
    c = c.hint("shuffle_hash").join(sites, "question_id").select("site_alias", "question_id", "id", F.lit("comment").alias("type"), "owner_id", *[none.alias(m) for m in ("answer_count", "view_count", "score", "comment_count")])
    return rows.unionByName(c)


POSTS = f"""{QUESTIONS}, {ANSWERS}, {COMMENTS},
    p AS MATERIALIZED (SELECT site AS site_alias, CAST(id AS VARCHAR) AS question_id, CAST(id AS VARCHAR) AS id, 'question' AS type, owner_id, CAST(answer_count AS DOUBLE) AS answer_count, view_count, score, comment_count FROM q
          UNION ALL SELECT site, CAST(parent_id AS VARCHAR), id, 'answer', owner_id, NULL, NULL, NULL, NULL FROM a
          UNION ALL SELECT q.site, CAST(q.id AS VARCHAR), CAST(k.id AS VARCHAR), 'comment', k.owner_id, NULL, NULL, NULL, NULL FROM k JOIN q ON CAST(q.id AS VARCHAR) = split_part(k.post_id, '-', 1))"""
CONSIDERED = f"""{POSTS}, co AS MATERIALIZED (SELECT question_id, site_alias, owner_id FROM p WHERE type = 'question' AND owner_id IS NOT NULL AND answer_count > 0),
    st AS MATERIALIZED (SELECT co.question_id, co.site_alias, count(*) AS total_answers, count(*) FILTER (WHERE g.owner_id = co.owner_id) AS self_answers
           FROM co JOIN (SELECT question_id, owner_id FROM p WHERE type = 'answer') g USING (question_id) GROUP BY 1, 2),
    sa AS MATERIALIZED (SELECT * FROM st WHERE self_answers > 0 AND self_answers = total_answers)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a topic (null for every 13th customer's) by the customer's number."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    topic = F.when(F.col("o_custkey") % 13 != 0, F.concat(F.lit("t"), (F.col("o_custkey") % 13).cast("string")))
    return questions(spark, sf_dir).join(o, "id").withColumn("topic", topic).drop("o_custkey")


CLASSIFIED = f"""{QUESTIONS}, {ANSWERS}, cl AS (SELECT q.*, CASE WHEN o_custkey % 13 <> 0 THEN concat('t', o_custkey % 13) END AS topic FROM q JOIN orders ON o_orderkey = q.id)"""


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, topic, subtopics, two verdicts and four ratings from labels and documents; some are null."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id")
    return d.select(
        k.alias("pos"),
        F.col("source").alias("topic"),
        F.when(k % 11 != 0, F.concat_ws("/", "source", "lang")).alias("subtopics"),
        F.when(k % 17 != 0, F.col("quality") == 1).alias("topic_veredict"),
        (F.col("toxic") == 0).alias("subtopic_veredict"),
        F.when(k % 7 != 0, F.col("quality")).alias("topic_validation_1"),
        F.when(k % 5 != 0, F.col("quality")).otherwise(1).alias("topic_validation_2"),
        F.when(k % 7 != 0, F.col("toxic")).alias("subtopic_validation_1"),
        F.when(k % 3 != 0, F.col("toxic")).otherwise(0).alias("subtopic_validation_2"),
    )


SHEET = """v AS (SELECT doc_id AS pos, source AS topic, CASE WHEN doc_id % 11 <> 0 THEN concat(source, '/', lang) END AS subtopics, CASE WHEN doc_id % 17 <> 0 THEN quality = 1 END AS topic_veredict, toxic = 0 AS subtopic_veredict,
        CASE WHEN doc_id % 7 <> 0 THEN quality END AS topic_validation_1, CASE WHEN doc_id % 5 <> 0 THEN quality ELSE 1 END AS topic_validation_2,
        CASE WHEN doc_id % 7 <> 0 THEN toxic END AS subtopic_validation_1, CASE WHEN doc_id % 3 <> 0 THEN toxic ELSE 0 END AS subtopic_validation_2
    FROM documents JOIN labels USING (doc_id))"""


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, site_alias, topic, topic_perc_contrib, subtopic from documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("crypto:"), F.col("doc_id").cast("string")).alias("question_id"), F.lit("crypto").alias("site_alias"), F.col("source").alias("topic"), (F.col("n_chars") / 100000.0).alias("topic_perc_contrib"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("subtopic"), (F.length("text") / 50000.0).alias("subtopic_perc_contrib"))


STRATA = """s AS (SELECT concat('crypto:', doc_id) AS question_id, 'crypto' AS site_alias, source AS topic, n_chars / 100000.0::DOUBLE AS topic_perc_contrib, CASE WHEN doc_id % 3 <> 0 THEN lang END AS subtopic, length(text) / 50000.0::DOUBLE AS subtopic_perc_contrib FROM documents)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens of all documents: lower case, parted by white space."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.filter(F.split(F.lower("text"), r"[ \t\r\n]+"), lambda w: w != "").alias("tokens"))


TEXTS = r"en AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda w: w <> '') AS tokens FROM documents)"
WORDS = f"{TEXTS}, wd AS (SELECT doc_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS pos FROM en)"


def technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, topic, topic_id, technologies: lists of languages, aliases and words of a part's name."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.replace("p_name", F.lit(" "), F.lit(", "))
    text = (
        F.when(k % 7 == 0, F.lit(None).cast("string"))
        .when(k % 7 == 1, F.concat(F.lit("Python, "), name))
        .when(k % 7 == 2, F.concat(name, F.lit(", AES-128,  aes-256")))
        .when(k % 7 == 3, F.concat(F.lit("c#,SHA256, "), name))
        .when(k % 7 == 4, F.lit(" Java, PKCS#7"))
        .when(k % 7 == 5, F.lit("Go"))
        .otherwise(F.concat(name, F.lit(", , C++, sha1")))
    )
    topic = F.col("p_size") % 25
    return p.select(k.alias("post_id"), F.when(topic != 0, F.concat(F.lit("topic "), topic.cast("string"))).alias("topic"), F.lpad(topic.cast("string"), 2, "0").alias("topic_id"), text.alias("technologies"))


TECHNOLOGIES = """tx AS (SELECT p_partkey AS post_id, CASE WHEN p_size % 25 <> 0 THEN concat('topic ', p_size % 25) END AS topic, lpad(CAST(p_size % 25 AS VARCHAR), 2, '0') AS topic_id,
        CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Python, ' || replace(p_name, ' ', ', ') WHEN 2 THEN replace(p_name, ' ', ', ') || ', AES-128,  aes-256' WHEN 3 THEN 'c#,SHA256, ' || replace(p_name, ' ', ', ')
             WHEN 4 THEN ' Java, PKCS#7' WHEN 5 THEN 'Go' ELSE replace(p_name, ' ', ', ') || ', , C++, sha1' END AS technologies FROM part)"""
