"""A corpus pipeline over ``documents``: filter, deduplicate twice, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadlens.llm import quality
from threadlens.llm.base import scratch, table
from threadlens.llm.bpe import encode_documents
from threadlens.llm.exact_dedup import keep_first
from threadlens.llm.mixing import mixed
from threadlens.llm.simhash import keep_one

#: Near-duplicates: words in a shingle, and Jaccard similarity of the sets of shingles from which on texts are linked.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of documents it is given.

    Null and empty texts are scored like any other; repeated rows and null ids
    share the fate of their text.  Without usable labels nothing is rejected or
    everything, as the one label that is there says; an empty table stays empty.
    """
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the document with the smallest id.

    A null text equals an empty one; a null id gives way to any other; of rows
    that repeat an id and a text one stays.  An empty table stays empty.
    """
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Texts of fewer words than a shingle count as one shingle, and texts without
    words, null ones too, as one group.  An empty table stays empty.
    """
    return keep_one(docs, NEAR_WORDS, similarity=NEAR_SIMILARITY)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights, a row for each pass that takes a document.

    A null source is a source of its own, the last one.  Documents without words
    are in no pass, so an empty table, or one without words, gives an empty mix.
    """
    return mixed(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each row of the mix, repeated rows and null ids too; a null text is an empty one."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe_encode", bpe_encode),
]

#: No SQL expresses the learned classifier or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
