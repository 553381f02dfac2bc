"""Round trips through the sources and sinks, and operators that the catalogue shows only inside others.

A query of the first kind writes a test table in the form that a source reads,
below the shared folder, and returns what the source gives back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SITES
from ..functions import text, values
from ..lineage import scratch
from ..operators import naming, quality, sampling, tag_relatedness, topic_model, topic_stats
from ..schema import require
from ..sources import dumps, tables
from . import proxies as P
from .catalog import _DICTIONARY, _tagged, _topic_posts, query, rounded

# --- sources and sinks ----------------------------------------------------------------------------------------------

_DUMP = """SELECT 'stackoverflow' AS site, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN '2' ELSE '1' END AS post_type,
        CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey % 10 AS VARCHAR) END AS owner_id, o_orderpriority || ' <b>&amp; "' || o_orderstatus || '"' AS title,
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE lower(o_orderstatus) || ';' || 'x' END AS tags FROM orders"""


def _dumped(spark, sf) -> str:
    """Orders as a dump of posts in the folder of the first site; the other sites have none."""
    root, o = scratch(spark, "dumps"), P.table(spark, sf, "orders")
    answer = F.col("o_orderkey") % 3 == 0
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("_Id"),
        F.when(answer, "2").otherwise("1").alias("_PostTypeId"),
        F.when(~answer, F.concat(F.lit("<"), F.lower("o_orderstatus"), F.lit("><x>"))).alias("_Tags"),
        F.concat("o_orderpriority", F.lit(' <b>&amp; "'), "o_orderstatus", F.lit('"')).alias("_Title"),
        F.when(F.col("o_custkey") % 10 == 0, "").otherwise((F.col("o_custkey") % 10).cast("string")).alias("_OwnerUserId"),
    )
    rows.write.format("xml").options(rootTag="posts", rowTag="row").save(f"{root}/{SITES[0].archive.removesuffix('.7z')}/Posts.xml")
    return root


@query("a3_xml_rows", _DUMP)
def a3(spark, sf):
    posts = dumps.read_posts(spark, _dumped(spark, sf), SITES)
    return posts.select("site", "id", "post_type", "owner_id", "title", F.array_join("tags", ";").alias("tags"))


@query("a2_members", "SELECT r_name AS site, name, r_regionkey % 2 = 0 AND name = 'Posts.xml' AS found FROM region, (SELECT unnest(['Posts.xml', 'Comments.xml']) AS name)")
def a2(spark, sf):
    """Every second region has a dump of posts; some folders bear the archive's ending."""
    root, regions = scratch(spark, "dumps"), P.table(spark, sf, "region")
    sites = sorted((r["r_name"], r["r_regionkey"]) for r in regions.collect())  # a row a site
    for name, key in sites:
        if key % 2 == 0:
            rows = regions.where(F.col("r_regionkey") == key).select(F.col("r_regionkey").cast("string").alias("_Id"))
            rows.write.format("xml").options(rootTag="posts", rowTag="row").save(f"{root}/{name}{'.7z' if key % 4 else ''}/Posts.xml")
    found = [(s, n, dumps.member(spark, root, f"{s}.7z", n) is not None) for s, _ in sites for n in ("Posts.xml", "Comments.xml")]
    return spark.createDataFrame(found, "site string, name string, found boolean")


@query("a4_missing_dump", "SELECT site, count(*) AS n FROM (" + _DUMP + ") GROUP BY 1")
def a4(spark, sf):
    return dumps.read_posts(spark, _dumped(spark, sf), SITES).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


def _awkward(spark, sf) -> DataFrame:
    """Cells with quotes, commas and line breaks."""
    p = P.table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit('a "'), "p_name", F.lit('",\nb')).alias("body"), F.when(F.col("p_size") > 9, F.col("p_brand")).alias("brand"))


_AWKWARD = "SELECT CAST(p_partkey AS VARCHAR) AS id, 'a \"' || p_name || '\",' || chr(10) || 'b' AS body, CASE WHEN p_size > 9 THEN p_brand END AS brand FROM part"


@query("a5_csv_append", _AWKWARD)
def a5(spark, sf):
    path, rows = f"{scratch(spark, 'csv')}/rows", _awkward(spark, sf)
    for half in (0, 1):
        tables.append_csv(rows.where(F.col("id").cast("bigint") % 2 == half), path)
    return tables.read_csv(spark, path)


@query("a6_csv_overwrite", _AWKWARD + " WHERE p_size > 20")
def a6(spark, sf):
    path, rows = f"{scratch(spark, 'csv')}/rows", _awkward(spark, sf)
    tables.write_csv(rows, path)
    tables.write_csv(rows.join(P.table(spark, sf, "part").where("p_size > 20").select(F.col("p_partkey").cast("string").alias("id")), "id", "left_semi"), path)
    return tables.read_csv(spark, path)


@query("a7_csv_typed", "SELECT o_orderkey AS id, o_totalprice AS price, o_orderpriority AS site FROM orders")
def a7(spark, sf):
    path = f"{scratch(spark, 'csv')}/rows"
    tables.write_csv(P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("site")), path)
    return tables.read_csv(spark, path, "id bigint, price double, site string")


@query("a8_related_tags", f"WITH {P.METRICS} SELECT DISTINCT site, tag FROM m")
def a8(spark, sf):
    path = f"{scratch(spark, 'related')}/tags"
    found = tag_relatedness.tag_metrics(_tagged(spark, sf), "ring").select("site", "tag", "h1", "h2")
    tables.write_stage(found.unionByName(found.withColumn("tag", F.lit(None).cast("string"))), path)
    return tables.read_related_tags(spark, path)


@query("a9_topic_names", "SELECT CAST(n_nationkey AS BIGINT) AS topic_index, n_name AS topic_name FROM nation")
def a9(spark, sf):
    """Half of the entries in either spelling of the keys, and one without an index."""
    folder = scratch(spark, "names")
    n = P.table(spark, sf, "nation")
    old = F.col("n_nationkey") % 2 == 0
    entry = F.struct(*[F.when(old if c[1] else ~old, c[2]).alias(c[0]) for c in (("topic_index", 0, F.col("n_nationkey")), ("topic_name", 0, F.col("n_name")), ("topic_id", 1, F.col("n_nationkey")), ("inferred_name", 1, F.col("n_name")))])
    nobody = F.array(F.from_json(F.lit('{"topic_name": "no index"}'), "topic_index int, topic_name string, topic_id int, inferred_name string"))
    listed = n.agg(F.collect_list(entry).alias("topics")).select(F.to_json(F.struct(F.concat("topics", nobody).alias("topics"))).alias("value"))
    listed.coalesce(1).write.text(f"{folder}/topic_inference_main.json")
    return tables.read_topic_names_or_default(spark, folder, "main")


@query("a10_model_meta", "SELECT CAST(n_nationkey + 2 AS INT) AS num_topics, n_nationkey / 10.0::DOUBLE AS alpha, CAST(NULL AS DOUBLE) AS coherence FROM nation")
def a10(spark, sf):
    """A file for each model."""
    path = f"{scratch(spark, 'meta')}/meta"
    n = P.table(spark, sf, "nation")
    n.repartitionById(n.count(), F.col("n_nationkey")).select((F.col("n_nationkey") + 2).alias("num_topics"), (F.col("n_nationkey") / 10).alias("alpha")).write.json(path)
    return tables.read_model_meta(spark, path).select("num_topics", "alpha", "coherence")


@query("a11_model_artifacts", f"""WITH {_DICTIONARY}, co AS (SELECT w AS term, count(*) AS n FROM wd WHERE w IN (SELECT term FROM di ORDER BY df DESC, term LIMIT 100000) GROUP BY 1)
    SELECT CAST(0 AS INT) AS topic, term, round((n + 0.01) / sum(n + 0.01) OVER () * 1e6, 4) AS p FROM co""")
def a11(spark, sf):
    """The model of one topic, which has a closed form, saved and loaded."""
    docs, path = P.words(spark, sf), scratch(spark, "model")
    topic_model.fit_topics(docs, topic_model.dictionary(docs), 1).save(path, spark, {"num_topics": 1})
    return topic_model.TopicModel.load(path, spark).phi(spark).select("topic", "term", F.round(F.col("p") * 1e6, 4).alias("p"))


@query("a11_bag_of_words", f"WITH {_DICTIONARY} SELECT doc_id, w AS term, count(*) AS n FROM wd WHERE w IN (SELECT term FROM di ORDER BY df DESC, term LIMIT 100000) GROUP BY 1, 2")
def a11_bow(spark, sf):
    docs, path = P.words(spark, sf), scratch(spark, "bow")
    return topic_model.saved_bag_of_words(topic_model.bag_of_words(docs, topic_model.dictionary(docs), "doc_id"), path)


@query("a12_sheet", f"WITH {P.STRATA} SELECT question_id AS id, topic, subtopic AS subtopics FROM s")
def a12(spark, sf):
    path = f"{scratch(spark, 'sheet')}/sheet.csv"
    tables.write_sheet(sampling.validation_sheet(P.strata(spark, sf)), path)
    return tables.read_sheet(spark, path).select("id", "topic", "subtopics")


@query("a14_report", "SELECT n_regionkey || ': ' || n_name AS line FROM nation")
def a14(spark, sf):
    path = f"{scratch(spark, 'report')}/topics.txt"
    tables.write_lines(P.table(spark, sf, "nation").select("n_nationkey", F.concat_ws(": ", F.col("n_regionkey").cast("string"), "n_name").alias("line")), path, "n_nationkey")
    return spark.read.text(path).withColumnRenamed("value", "line")


# --- operators that others contain ----------------------------------------------------------------------------------


@query("b2_safe_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS raw FROM orders")
def b2(spark, sf):
    return P.table(spark, sf, "orders").select("o_orderkey", values.safe_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("raw"))


@query("c12_required", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def c12(spark, sf):
    return require(P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), id="number", price="number")


@query("c14_with_topic", f"WITH {P.CLASSIFIED} SELECT id, topic FROM cl WHERE topic IS NOT NULL")
def c14(spark, sf):
    return topic_stats.with_topic(P.classified(spark, sf)).select("id", "topic")


@query("d6_question_answers", f"WITH {P.CONSIDERED} SELECT CAST(co.question_id AS BIGINT) AS question_id, CAST(co.owner_id AS INT) AS owner_q, g.id AS answer_id, CAST(g.owner_id AS INT) AS owner_a FROM co JOIN p g ON g.question_id = co.question_id AND g.type = 'answer'")
def d6(spark, sf):
    out = quality.question_answers(P.posts(spark, sf))
    return out.select(F.col("question_id").cast("bigint").alias("question_id"), F.col("owner_q").cast("int").alias("owner_q"), "answer_id", F.col("owner_a").cast("int").alias("owner_a"))


@query("e4_cooccurrence", f"WITH {P.TAGS} SELECT site, tag, count(*) AS a FROM x WHERE anchored GROUP BY 1, 2")
def e4(spark, sf):
    return tag_relatedness.tag_counts(_tagged(spark, sf), "ring").where("a > 0").select("site", "tag", "a")


@query("s3_concatenated_sites", f"WITH {P.QUESTIONS} SELECT site, id FROM q")
def s3(spark, sf):
    """Sets of each site, kept in folders of their own, read as one table by one scan."""
    path = f"{scratch(spark, 'sites')}/questions"
    P.questions(spark, sf).select("site", "id").write.partitionBy("site").parquet(path)
    return spark.read.schema("id bigint, site string").parquet(path).select("site", "id")


@query("h3_answer_schema", "SELECT CAST(n_nationkey AS BIGINT) AS topic_index, n_name AS topic_name FROM nation WHERE n_regionkey <> 0")
def h3(spark, sf):
    """An answer for each nation, in either spelling of the keys; some lack the index, some the name, some are no JSON."""
    n = P.table(spark, sf, "nation")
    key, name = F.col("n_nationkey"), F.col("n_name")
    no = F.lit(None).cast("string")
    old = F.to_json(F.struct(F.array(F.struct(key.alias("topic_id"), name.alias("inferred_name"), F.lit("r").alias("rationale"))).alias("topics")))
    new = F.to_json(F.struct(F.array(F.struct(key.alias("topic_index"), name.alias("topic_name")), F.struct(key.alias("topic_index"), no.alias("topic_name"))).alias("topics")))
    bad = F.when(key % 3 == 0, F.lit('{"topics": [{"topic_name": "no index"}]}')).when(key % 3 == 1, F.lit("no json"))
    return naming.parsed_answers(n.select(F.when(F.col("n_regionkey") == 0, bad).when(key % 2 == 0, old).otherwise(new).alias("answer")), "answer")


_HEAVY = """hw AS (SELECT p_partkey % 7 AS topic, p_name AS term, p_retailprice / 100000.0::DOUBLE AS weight, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
    he AS (SELECT * FROM hw WHERE rank <= 20)"""


def _heavy(spark, sf) -> DataFrame:
    """topic, rank, term, weight from parts, as words_per_topic gives them."""
    from pyspark.sql import Window

    p = P.table(spark, sf, "part").withColumn("topic", (F.col("p_partkey") % 7).cast("int"))
    order = Window.partitionBy("topic").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return p.withColumn("rank", F.row_number().over(order)).where("rank <= 20").select("topic", "rank", F.col("p_name").alias("term"), (F.col("p_retailprice") / 100000.0).alias("weight"))


@query("b25_lines_of_words", f"""WITH {_HEAVY} SELECT CAST(topic AS INT) AS topic, 'Topic ' || topic || ': [' || string_agg(printf('word: "%s" weight: (%.3f)', term, weight), ', ' ORDER BY rank) || ']' AS line FROM he GROUP BY topic""")
def b25_words(spark, sf):
    return topic_model.topic_lines(_heavy(spark, sf))


@query("h1_names_of_words", f"WITH {_HEAVY} SELECT topic AS topic_index, string_agg(term, ', ' ORDER BY rank) AS topic_name FROM he WHERE rank <= 3 GROUP BY 1")
def h1_words(spark, sf):
    return naming.default_names(_heavy(spark, sf))


@query("g12_top_words", f"WITH {_HEAVY} SELECT CAST(topic AS INT) AS topic, CAST(rank AS INT) AS rank, term FROM he WHERE rank <= 5")
def g12(spark, sf):
    return _heavy(spark, sf).where("rank <= 5").select("topic", "rank", "term")


@query("g14_topic_plan")
def g14(spark, sf):
    """The whole chain on the conversations: main model, names, topics, submodels and subtopics."""
    from ..config import TopicModelOptions
    from . import topics

    posts = _topic_posts(spark, sf)
    options = TopicModelOptions(iterations=20, topic_counts=(3,))
    out = topics.run(posts, "key", "turn", folder=scratch(spark, "models"), mode="fixed", options=options)
    return out.questions.select("question_id", "topic", "topic_name", "subtopic", "subtopic_name")
