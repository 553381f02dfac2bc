import logging

from pyspark.sql import functions as F

from threadlens.config import TopicModelOptions
from threadlens.functions import labels
from threadlens.log import get_logger
from threadlens.operators import topic_model
from threadlens.sources import tables


def test_labels(spark):
    df = spark.createDataFrame([("one two three",), ("incomprehensibilities a b",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(labels.wrapped(F.col("t"), 8), labels.line_count(labels.wrapped(F.col("t"), 8))).collect()]
    assert got[:3] == [("one two\nthree", 2), ("incomprehensibilities\na b", 2), ("", 1)]
    assert df.select(labels.initials(F.lit("Public-Key Cryptography and more"))).first()[0] == "PKC"


def test_logger_has_one_handler_each(tmp_path):
    path = str(tmp_path / "a.log")
    for _ in range(3):
        logger = get_logger("threadlens.tests", path)
    logger.info("hello")
    assert len(logger.handlers) == 2 and "hello" in open(path).read()
    assert logger.level == logging.INFO


def test_related_tags(spark, tmp_path):
    spark.createDataFrame([("s", "a", 1), ("s", "a", 2), ("s", None, 3)], "site string, tag string, b int").write.parquet(f"{tmp_path}/r")
    assert [tuple(r) for r in tables.read_related_tags(spark, f"{tmp_path}/r").collect()] == [("s", "a")]


def test_submodels_skip_what_fails(spark, monkeypatch):
    """A fit of all submodels that fails is repeated for each alone; one that fails again has its reason."""
    words = ["w1", "w2"]
    posts = spark.createDataFrame([("q1", "question", 0, words), ("q1", "answer", None, words), ("q2", "question", 1, words)], "question_id string, type string, topic int, tokens array<string>")
    asked = []

    def evaluate(docs, key, wanted, terms, *rest):
        asked.append({corpus: docs.where(F.col("corpus") == corpus).count() for corpus, _ in wanted.values()})
        if 1 in asked[-1]:
            raise ValueError("too few")
        return {m: topic_model.Trial(k, 0.5, 1.0, None) for m, (_, k) in wanted.items()}

    monkeypatch.setattr(topic_model, "evaluate", evaluate)
    options = TopicModelOptions(min_documents=1.0, max_document_share=1.0)
    found, failed = topic_model.train_submodels(posts, posts, [0, 1], "question_id", "fixed", 2, options=options)
    assert set(found) == {0} and found[0].topics == 2
    assert failed[1] == "no model could be fitted" and set(failed) == {1}
    assert asked[0] == {0: 2, 1: 1} and {0: 2} in asked and {1: 1} in asked
