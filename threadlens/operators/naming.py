"""Names of topics: from stored answers, from any callable, or from the heaviest words."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TOPIC_NAMES

log = logging.getLogger(__name__)


def prompt_terms(words: DataFrame) -> DataFrame:
    """topic, line with weights of six decimals, as a prompt shows them."""
    from .topic_model import topic_lines

    return topic_lines(words, 6)


def default_names(words: DataFrame, k: int = 3) -> DataFrame:
    """topic_index, topic_name from the k heaviest words."""
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "term")))), lambda x: x["term"])
    return words.groupBy(F.col("topic").cast("bigint").alias("topic_index")).agg(F.array_join(listed, ", ").alias("topic_name"))


def default_subnames(words: DataFrame, k: int = 3) -> DataFrame:
    """topic, topic_index, topic_name of all submodels at once; ``words``: topic (the main one), subtopic, rank, term."""
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "term")))), lambda x: x["term"])
    return words.groupBy("topic", F.col("subtopic").cast("bigint").alias("topic_index")).agg(F.array_join(listed, ", ").alias("topic_name"))


def ask_names(words: DataFrame, template: str, ask: Callable[[str], str]) -> dict[int, str]:
    """Names by a language model: ``ask`` takes the filled prompt and returns JSON.

    A failed call is logged and gives no names.  One row a topic reaches the driver.
    """
    lines = "\n".join(r["line"] for r in prompt_terms(words).orderBy("topic").collect())
    try:
        return parse_names(json.loads(ask(template.replace("{topics}", lines))))
    except Exception as e:  # noqa: BLE001  naming is optional
        log.warning("topics could not be named: %s", e)
        return {}


def parse_names(answer: Mapping) -> dict[int, str]:
    """Accepts both spellings of an answer's keys."""
    out = {}
    for t in answer.get("topics", []):
        index, name = t.get("topic_index", t.get("topic_id")), t.get("topic_name", t.get("inferred_name"))
        if index is not None and name is not None:
            out[int(index)] = str(name)
    return out


def parsed_answers(answers: DataFrame, column: str) -> DataFrame:
    """topic_index, topic_name of a column of answers as JSON, in either spelling of the keys.

    What is no JSON, and topics without an index or a name, are left out.
    """
    rows = answers.select(F.inline(F.from_json(column, TOPIC_NAMES)["topics"]))
    rows = rows.select(F.coalesce("topic_index", "topic_id").alias("topic_index"), F.coalesce("topic_name", "inferred_name").alias("topic_name"))
    return rows.where("topic_index IS NOT NULL AND topic_name IS NOT NULL")


def with_names(df: DataFrame, names: DataFrame, topic: str = "topic", into: str = "topic_name") -> DataFrame:
    """Adds the topic's name, or its id where it has none.  One row a topic in ``names``."""
    named = names.select(F.col("topic_index").alias(topic), F.col("topic_name").alias("_name"))
    return df.join(named, topic, "left").withColumn(into, name_or_id(F.col("_name"), F.col(topic))).drop("_name")


def name_or_id(name: Column, topic: Column) -> Column:
    return F.coalesce(name, topic.cast("string"))
