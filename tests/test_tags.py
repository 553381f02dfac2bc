import pytest
from pyspark.sql import functions as F

from threadlens.functions import tags
from threadlens.operators import tag_relatedness as R


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, []), ("", []), ("<a><c++>", ["a", "c++"]), ("a;b; ;c", ["a", "b", "c"]), ("|a|b|", ["a", "b"]), ("a, b c", ["a", "b", "c"]),
        ("a;b c", ["a", "b c"]), ("<a", ["<a"]), ("< a >", [" a "]), ("a|b;c", ["a|b", "c"]), ("<>", []), ("  ", []), ("one", ["one"]), ("<a>;<b>", ["a", "b"]),
    ],
)
def test_parse_tags(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(tags.parse_tags(F.col("raw"))).first()[0] == want


@pytest.mark.parametrize(
    "alias, qid, want",
    [
        (None, "stackoverflow:5", "https://stackoverflow.com/questions/5"), ("", "crypto:5", "https://crypto.stackexchange.com/questions/5"),
        ("security", "crypto:5", "https://security.stackexchange.com/questions/5"), ("crypto", "5.0", "https://crypto.stackexchange.com/questions/5"),
        ("crypto", None, ""), ("crypto", "a:b:c", "https://crypto.stackexchange.com/questions/a:b:c"), (None, "7", "https://nan.stackexchange.com/questions/7"),
    ],
)
def test_question_link(spark, alias, qid, want):
    df = spark.createDataFrame([(alias, qid)], "a string, q string")
    assert df.select(tags.question_link(F.col("a"), F.col("q"))).first()[0] == want


def test_ids(spark):
    df = spark.createDataFrame([("5",), ("",), (None,)], "i string")
    assert [r[0] for r in df.select(tags.qualified_id(F.lit("x"), F.col("i"))).collect()] == ["x:5", None, None]
    assert df.select(tags.join_tags(F.array(F.lit("b"), F.lit("a"), F.lit("b")))).first()[0] == "a;b"


def questions(spark):
    rows = [("s", 1, ["ring", "x"]), ("s", 2, ["ring", "y"]), ("s", 3, ["x"]), ("s", 4, ["z"]), ("s", 5, []), ("t", 6, ["x"])]
    return spark.createDataFrame(rows, "site string, id int, tags array<string>")


def test_metrics(spark):
    got = {(r.site, r.tag): (r.b, r.a, r.h1, r.h2) for r in R.tag_metrics(questions(spark), "ring").collect()}
    # z never meets the anchor, and site t has no anchor at all.
    assert got == {("s", "ring"): (2, 2, 1.0, 1.0), ("s", "x"): (2, 1, 0.5, 0.5), ("s", "y"): (1, 1, 1.0, 0.5)}
    assert R.tag_metrics(questions(spark), "absent").collect() == []
    every = {r.tag: (r.b, r.a) for r in R.tag_metrics(questions(spark), "ring", by_site=False).collect()}
    assert every == {"ring": (2, 2), "x": (3, 1), "y": (1, 1)}


def test_filters(spark):
    m = R.tag_metrics(questions(spark), "ring")
    assert {r.tag for r in R.above_thresholds(m, 0.5, 0.5).collect()} == {"ring", "x", "y"}  # a value at the threshold stays
    assert {r.tag for r in R.above_thresholds(m, None, 0.6).collect()} == {"ring"}
    assert R.above_thresholds(m, None, None).count() == 3
    assert tuple(R.removal_tallies(m, 0.6, 0.6).first()) == (0, 1, 1)
    denied = spark.createDataFrame([("s", "x"), ("t", "y")], "site string, tag string")
    assert {r.tag for r in R.without_denied(m, denied).collect()} == {"ring", "y"}
    related = spark.createDataFrame([("s", "x"), ("s", "y")], "site string, tag string")
    assert sorted(r.id for r in R.related_questions(questions(spark), related).collect()) == [1, 2, 3]
    assert sorted(r.question_id for r in R.coarse_questions(questions(spark), ("ring", "z")).collect()) == ["1", "2", "4"]


def test_sweep(spark):
    m = R.tag_metrics(questions(spark), "ring").where("site = 's'")
    swept = R.sweep(m, R.grid(spark, (0.4, 0.9), (0.1, 0.9, 2.0))).orderBy("combination").collect()
    assert [(r.combination, r.num_tags, r.tags) for r in swept] == [
        ("TRH1_0.400_TRH2_0.100", 3, ["ring", "x", "y"]), ("TRH1_0.400_TRH2_0.900", 1, ["ring"]), ("TRH1_0.400_TRH2_2.000", 0, []),
        ("TRH1_0.900_TRH2_0.100", 2, ["ring", "y"]), ("TRH1_0.900_TRH2_0.900", 1, ["ring"]), ("TRH1_0.900_TRH2_2.000", 0, []),
    ]
    frame = spark.createDataFrame(swept)
    ends = {r.extreme: (r.combination, r.num_tags) for r in R.sweep_extremes(frame).collect()}
    assert ends == {"fewest": ("TRH1_0.400_TRH2_2.000", 0), "median": ("TRH1_0.900_TRH2_0.900", 1), "most": ("TRH1_0.400_TRH2_0.100", 3)}
    wide = R.sweep_wide(frame, [r.combination for r in swept]).orderBy("pos").collect()
    assert [list(r)[1:] for r in wide] == [["ring", "ring", "", "ring", "ring", ""], ["x", "", "", "y", "", ""], ["y", "", "", "", "", ""]]
