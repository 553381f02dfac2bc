import math
from datetime import datetime

import numpy as np
import pytest

from threadlens.operators import agreement, fused, kendall, sampling, technology, topic_stats, trends

# Published values for 21 topics: mean views, score, comments, hours and share without an accepted answer.
# Columns: avg_views, avg_score, avg_comments, avg_hours, avg_no_accepted_answer.
TOPICS = [
    (25068.844262295082, 12.241803278688524, 5.270491803278689, 1093.4545064105123, 0.3155737704918033),
    (21268.470588235294, 16.702205882352942, 5.727941176470588, 504.79990695436504, 0.27941176470588236),
    (23881.09216589862, 24.207373271889402, 6.184331797235023, 617.2917108482476, 0.31336405529953915),
    (9690.277777777777, 13.38888888888889, 6.388888888888889, 30.927099265873014, 0.2222222222222222),
    (31493.894736842107, 18.892230576441104, 5.130325814536341, 1064.026096252507, 0.3057644110275689),
    (25604.44171779141, 30.226993865030675, 6.012269938650307, 903.1945062404579, 0.19631901840490798),
    (19791.446969696968, 31.303030303030305, 7.106060606060606, 18.42503162962963, 0.3181818181818182),
    (29073.131355932204, 15.608050847457626, 5.612288135593221, 832.4027749309435, 0.24152542372881355),
    (25333.128078817736, 22.014778325123153, 5.995073891625616, 1697.1438180749806, 0.2955665024630542),
    (15936.37062937063, 28.055944055944057, 6.755244755244755, 199.86612049691362, 0.3706293706293706),
    (35506.09210526316, 28.875, 4.8355263157894735, 698.5091363835471, 0.3157894736842105),
    (19314.060109289618, 19.39344262295082, 5.8469945355191255, 569.2540359360411, 0.34972677595628415),
    (65165.54989384289, 33.72611464968153, 5.193205944798302, 1438.1870772972425, 0.4182590233545648),
    (33900.51986754967, 40.62251655629139, 6.377483443708609, 387.2623656539352, 0.2052980132450331),
    (16221.274509803921, 39.28431372549019, 7.6568627450980395, 163.13336720679013, 0.29411764705882354),
    (25013.366515837104, 23.936651583710407, 5.484162895927602, 542.0874420794754, 0.34841628959276016),
    (17152.603305785124, 24.1900826446281, 6.454545454545454, 914.1464109300875, 0.2644628099173554),
    (21482.40740740741, 30.488888888888887, 6.562962962962963, 1405.2539189222223, 0.25925925925925924),
    (19473.88495575221, 41.78761061946903, 7.929203539823009, 738.7221007575758, 0.3185840707964602),
    (17125.795454545456, 16.34090909090909, 6.4602272727272725, 536.1476154415955, 0.3352272727272727),
    (57693.3598820059, 33.3952802359882, 5.112094395280236, 2628.651434222222, 0.336283185840708),
]
# Published correlations: (tau, p) to three decimals.
TAUS = {
    ("avg_views", "avg_no_accepted_answer"): (-0.029, 0.882), ("avg_views", "avg_hours"): (0.448, 0.004), ("avg_comments", "avg_no_accepted_answer"): (-0.095, 0.571),
    ("avg_comments", "avg_hours"): (-0.381, 0.016), ("avg_score", "avg_no_accepted_answer"): (0.114, 0.492), ("avg_score", "avg_hours"): (0.038, 0.835), ("fused_popularity", "fused_difficulty"): (0.105, 0.531),
}


@pytest.fixture(scope="module")
def published(spark):
    """Both metrics computed from one question a topic whose values are the published means."""
    q = spark.createDataFrame([(f"T{k:02d}", *r[:3]) for k, r in enumerate(TOPICS)], "topic string, view_count double, score double, comment_count double")
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(f"T{k:02d}", r[3], r[4]) for k, r in enumerate(TOPICS)], "topic string, avg_hours double, avg_no_accepted_answer double")
    d = d.withColumns({"T_hat": fused.relative("avg_hours"), "P_hat": fused.relative("avg_no_accepted_answer")}).withColumn("fused_difficulty", (F.col("P_hat") + F.col("T_hat")) / 2)
    return fused.fused(fused.popularity(q), d).cache()


def test_published_fusion(published):
    first = published.where("topic = 'T00'").first()
    assert abs(first.V_hat - 0.9482262249945831) < 1e-12 and abs(first.fused_popularity - 0.7614149357463545) < 1e-12
    assert abs(first.T_hat - 1.3520990478949972) < 1e-12 and abs(first.fused_difficulty - 1.2016735654333308) < 1e-12
    assert published.count() == 21 and fused.quadrants(published).count() == 21


def test_published_correlations(published):
    got = {(r.x, r.y): (round(r.tau, 3), round(r.p, 3)) for r in kendall.kendall(published).collect()}
    assert got == TAUS
    table = {r.metric: (r["no accepted answer"], r["hours"]) for r in kendall.correlation_table(kendall.kendall(published)).collect()}
    assert table["Views (avg)"] == ("-0.029 [0.882]", "0.448 [0.004]")
    assert table["Fused Popularity vs Fused Difficulty"] == ("0.105 [0.531]", "")


def test_kendall_edges(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0, 1.0), (2.0, 2.0, 5.0, None), (3.0, 2.0, 5.0, 2.0), (4.0, 4.0, 5.0, 3.0)], "a double, b double, c double, d double")
    got = {(r.x, r.y): r for r in kendall.kendall(df, (("a", "b"), ("a", "c"), ("a", "d"))).collect()}
    tied = got["a", "b"]
    assert abs(tied.tau - 5 / math.sqrt(6 * 5)) < 1e-12 and 0 < tied.p < 0.15
    assert got["a", "c"].tau is None and (got["a", "c"].p is None or math.isnan(got["a", "c"].p))
    assert got["a", "d"].n == 3 and got["a", "d"].tau == 1.0 and abs(got["a", "d"].p - 1 / 3) < 1e-12
    # The exact distribution sums to one: p of the least inversions for n = 3 is 2/3!, and of the middle 1.
    assert [kendall.exact_p(3, k) for k in range(4)] == [1 / 3, 1.0, 1.0, 1 / 3]


def question(i, topic, accepted, at=None):
    return (i, topic, accepted, datetime(2020, 1, 1) if at is None else at)


def test_difficulty_edges(spark):
    schema = "id string, topic string, accepted_answer_id string, creation_date timestamp"
    q = spark.createDataFrame([question("1", "a", "x"), question("2", "a", None), question("3", "b", "late"), question("4", "c", "lost"), question("5", None, "x")], schema)
    a = spark.createDataFrame([("x", datetime(2020, 1, 1, 5, 30)), ("late", datetime(2019, 1, 1))], "id string, creation_date timestamp")
    got = {r.topic: r for r in fused.difficulty(q, a).collect()}
    # b's answer is older than its question, c's is not in the data: both take the mean of the known topics.
    assert {t: r.avg_hours for t, r in got.items()} == {"a": 5.5, "b": 5.5, "c": 5.5}
    assert {t: r.avg_no_accepted_answer for t, r in got.items()} == {"a": 0.5, "b": 0.0, "c": 0.0}
    none = fused.difficulty(q.where("id = '4'"), a).first()
    assert (none.avg_hours, none.T_hat, none.P_hat, none.fused_difficulty) == (1.0, 1.0, 0.0, 0.5)


def test_allocation(spark):
    sizes = spark.createDataFrame([("a", 500, 0.2), ("b", 300, 0.1), ("c", 200, 0.3), ("d", 1, None)], "topic string, stratum_size bigint, within_sd double")
    got = {r.topic: r.allocated for r in sampling.allocation(sizes, 1001).collect()}
    n = 384.16 / (1 + 383.16 / 1001)
    raw = {"a": n * 100 / 190, "b": n * 30 / 190, "c": n * 60 / 190}
    assert sum(got.values()) == math.ceil(n) and got["d"] == 0
    assert all(math.ceil(v) - got[t] in (0, 1) for t, v in raw.items())
    assert [r.allocated for r in sampling.allocation(sizes.where("topic = 'd'"), 1).collect()] == [0]
    q = spark.createDataFrame([("s:1", "s", "a", 0.5, 3), ("s:2", "s", "a", 0.9, None), ("s:3", "s", "a", 0.5, 4), ("s:4", "s", "a", None, 5), ("s:5", "s", "b", 0.1, 1)], "question_id string, site_alias string, topic string, topic_perc_contrib double, subtopic int")
    allocated = spark.createDataFrame([("a", 2), ("b", 9), ("z", 3)], "topic string, allocated bigint")
    sample = sampling.allocated_sample(q, allocated)
    assert sorted(r.question_id for r in sample.collect()) == ["s:1", "s:2", "s:5"]
    sheet = sampling.validation_sheet(sample).orderBy("id").collect()
    assert sheet[0].link == "https://s.stackexchange.com/questions/1" and sheet[0].subtopics == "3" and sheet[0].technologies == "" and len(sheet[0]) == 12


def test_hierarchy(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "z"), ("b", None)]
    levels = topic_stats.hierarchy(spark.createDataFrame(rows, "topic string, subtopics string"))
    got = {(r.topic, r.subtopic): (r.n_topic, r.pct_topic, r.n_subtopic, round(r.pct_subtopic, 3)) for r in levels.collect()}
    assert got == {("a", "x"): (3, 60.0, 2, 66.667), ("a", "y"): (3, 60.0, 1, 33.333), ("b", "z"): (2, 40.0, 1, 50.0)}
    assert [r.line for r in topic_stats.report_lines(levels).collect()] == ["a: 60.00% (3 posts)", "  - x: 66.67% (2 posts)", "  - y: 33.33% (1 posts)", "b: 40.00% (2 posts)", "  - z: 50.00% (1 posts)"]
    nested = {r.topic: [s.name for s in r.subtopics] for r in topic_stats.nested_hierarchy(levels).collect()}
    assert nested == {"a": ["x", "y"], "b": ["z"]}
    # Published: the largest of 21 topics has 44 of 311 validated posts.
    many = spark.createDataFrame([("big", "s")] * 44 + [("rest", "s")] * 267, "topic string, subtopics string")
    assert [r.line for r in topic_stats.report_lines(topic_stats.hierarchy(many)).collect()][2] == "big: 14.15% (44 posts)"


SHEET = "pos int, topic string, topic_veredict boolean, subtopic_veredict boolean, topic_validation_1 int, topic_validation_2 int, subtopic_validation_1 int, subtopic_validation_2 int"


def test_agreement(spark):
    rows = [(1, "a", True, True, 1, 1, 0, 1), (2, "a", True, None, None, None, 1, 1), (3, "b", False, True, 1, 0, 1, 1), (4, "b", None, False, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, SHEET)
    assert [tuple(r) for r in agreement.invalid_table(df).collect()] == [("b", 2, 2, 0), ("a", 1, 2, 1), ("Total", 3, 4, 1)]
    got = {r.pair: (r.n, r.po_topic, r.kappa_topic, r.po_subtopic, r.kappa_subtopic) for r in agreement.kappa(df, "pos", first=2).collect()}
    assert got == {"pair 1": (2, 0.5, 0.0, 0.5, 0.0), "pair 2": (2, 0.5, 0.0, 1.0, 1.0)}
    assert {r.topic: r.mean_topic_veredict for r in agreement.verdict_means(df, "topic").collect()} == {"a": 1.0, "b": 0.0}


def test_usage_patterns(spark):
    shares = [("wide", t, 1.0) for t in ("01", "02", "03", "04")] + [("narrow", "01", 8.0), ("nearly", "01", 7.99), ("three", "01", 1.0), ("three", "02", 1.0), ("three", "03", 1.0), ("outside", "99", 50.0)]
    by_topic = spark.createDataFrame(shares, "tech string, topic_id string, pct double")
    patterns = technology.usage_patterns(by_topic)
    assert {r.tech: r.pattern for r in patterns.collect()} == {"wide": "cross-cutting", "narrow": "topic-specific", "nearly": "sparse", "three": "sparse", "outside": "sparse"}
    terms = technology.taxonomy(spark, {"B": ["Wide (3.5)", "narrow (0.5)"], "A": ["unknown (1)"]})
    table = technology.pattern_table(patterns, terms).collect()
    assert [tuple(r) for r in table] == [("B", 1, 1, 0), ("A", 0, 0, 0), ("Total", 1, 1, 0)]
    assert {r.category: r.sparse for r in technology.pattern_shares(technology.pattern_table(patterns, terms)).collect()} == {"B": 0.0, "A": None}
    assert [r.tech for r in technology.heatmap(by_topic, terms).collect()] == ["wide", "narrow"]
    assert [r.tech for r in technology.heatmap(by_topic, terms, least_share=1.0).collect()] == ["wide"]


def test_technology_shares(spark):
    posts = spark.createDataFrame([(1, "t", "aes, aes, x"), (2, "t", None), (3, "u", "aes,"), (4, None, "aes")], "post_id int, topic string, technologies_clean string")
    assert {r.tech: (r.n, r.pct) for r in technology.technology_counts(posts).collect()} == {"aes": (4, 100.0), "x": (1, 25.0)}
    got = {(r.tech, r.topic): (r.n, r.pct) for r in technology.technology_by_topic(posts).collect()}
    assert got == {("aes", "t"): (1, 50.0), ("x", "t"): (1, 50.0), ("n/a", "t"): (1, 50.0), ("aes", "u"): (1, 100.0), ("n/a", "u"): (1, 100.0)}


def test_trend(spark):
    rows = [(datetime(2020, 1, 1), "a"), (datetime(2020, 6, 1), None), (datetime(2021, 1, 1), "a"), (None, "a")]
    got = {(r.year, r.topic): (r.n, r.total, r.pct) for r in trends.topic_trend(spark.createDataFrame(rows, "creation_date timestamp, topic string")).collect()}
    assert got == {(2020, "a"): (1, 2, 50.0), (2021, "a"): (1, 1, 100.0)}


def test_confidence_levels():
    assert [sampling.z_of(c) for c in (0.9, 0.95, 0.99)] == [1.64, 1.96, 2.58]
    for c in (0, 1, 95):
        with pytest.raises(ValueError):
            sampling.z_of(c)


def test_long_kendall_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    u = rng.normal(size=2000).round(1)
    frame = {"a": u, "b": (u + rng.normal(size=2000)).round(2), "c": rng.integers(0, 3, 2000).astype(float), "d": np.where(rng.random(2000) < 0.4, 7.0, rng.normal(size=2000)), "e": np.ones(2000)}
    rows = [tuple(float(frame[k][i]) for k in "abcde") for i in range(2000)] + [(None, 1.0, 1.0, 1.0, 1.0), (1.0, float("nan"), None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    pairs = [("a", "b"), ("a", "c"), ("d", "b"), ("d", "d"), ("a", "e")]
    short = {(r.x, r.y): r for r in kendall.kendall(df.where("a IS NOT NULL AND c IS NOT NULL"), pairs[:1]).collect()}
    for size in (100, 700, 50_000):
        got = {(r.x, r.y): r for r in kendall.kendall_long(df, pairs, block_rows=size).collect()}
        for x, y in pairs:
            keep = [r for r in rows if all(r["abcde".index(k)] is not None and r["abcde".index(k)] == r["abcde".index(k)] for k in (x, y))]
            p, q = (np.array([r["abcde".index(k)] for r in keep]) for k in (x, y))
            signs = [np.sign(p[:, None] - p), np.sign(q[:, None] - q)]
            s, du, dv = ((signs[0] * signs[1]).sum() // 2, *(np.abs(x).sum() // 2 for x in signs))
            if not du or not dv:
                assert got[x, y].tau is None and got[x, y].p is None
                continue
            assert got[x, y].n == len(keep) and got[x, y].tau == pytest.approx(s / math.sqrt(du) / math.sqrt(dv), abs=1e-12)
            assert got[x, y].p == pytest.approx(kendall.p_value(len(keep), int(s), p, q), abs=1e-12)
        assert got["a", "b"].tau == pytest.approx(short["a", "b"].tau) and got["d", "d"].tau == pytest.approx(1.0)


def test_long_kendall_of_many_rows(spark):
    from pyspark.sql import functions as F

    df = spark.range(100_000).select("id", ((F.col("id") * 7919) % 100_003).alias("x"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(50_000)) + F.col("id") / 4).alias("y"))
    got = kendall.kendall_long(df, [("x", "y")], block_rows=5_000).first()
    local = df.orderBy("x", "y").toPandas()
    falling = kendall.inversions(local["y"].to_numpy(), np.ones(len(local), np.int64))
    pairs = 100_000 * 99_999 // 2
    equal = sum(int(k) * (int(k) - 1) // 2 for k in local["y"].value_counts())
    assert got.n == 100_000 and got.tau == pytest.approx((pairs - equal - 2 * falling) / math.sqrt(pairs) / math.sqrt(pairs - equal), abs=1e-12)
    assert kendall.kendall_long(df.limit(0), [("x", "y")]).first().tau is None


def test_merge_counting():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 17, 100, 333):
        v, w = rng.integers(0, 20, n).astype(float), rng.integers(1, 5, n)
        assert kendall.inversions(v, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if v[i] > v[j])
