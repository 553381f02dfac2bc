"""From normalised posts to classified questions: main model, its names, submodels, their names, subtopics."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TopicModelOptions
from ..lineage import cut
from ..operators import naming, topic_model
from ..schema import require

log = logging.getLogger(__name__)


@dataclass
class Topics:
    main: topic_model.Trial
    submodels: dict[int, topic_model.Trial]
    #: topic_index, topic_name of the main model, and topic, topic_index, topic_name of the submodels.
    names: DataFrame
    subnames: DataFrame
    posts: DataFrame
    questions: DataFrame
    #: Main topics without a submodel, and why.
    failed: dict[int, str]


def fitted(posts: DataFrame, key: str, mode: str | None = None, topics: int | None = None, options: TopicModelOptions = TopicModelOptions(), method: str = "gibbs") -> topic_model.Trial | None:
    """One model of posts (with tokens).  ``mode`` is search or fixed; by default the environment's LDA_MODE, else search."""
    require(posts, key, tokens="array")
    return topic_model.train(posts, key, mode or os.environ.get("LDA_MODE", "search"), topics, options=options, method=method)


def named(model: topic_model.TopicModel, spark, ask: Callable[[str], str] | None = None, template: str = "{topics}") -> DataFrame:
    """topic_index, topic_name of every topic: as ``ask`` says, or its heaviest words where that gives none."""
    words = topic_model.words_per_topic(model, spark)
    told = naming.ask_names(words, template, ask) if ask else {}
    asked = spark.createDataFrame([(int(k), v) for k, v in sorted(told.items())], "topic_index bigint, asked string")
    plain = naming.default_names(words)
    return plain.join(asked, "topic_index", "left").select("topic_index", F.coalesce("asked", "topic_name").alias("topic_name"))


def named_submodels(models: dict[int, topic_model.TopicModel], spark: SparkSession, ask: Callable[[str], str] | None = None, template: str = "{topics}") -> DataFrame:
    """topic, topic_index, topic_name of the topics of all submodels.  With ``ask`` each submodel is asked for by itself; what it leaves out has its words."""
    words = [(topic, k, r + 1, w) for topic, model in sorted(models.items()) for k, found in enumerate(model.top_words(20)) for r, (w, _) in enumerate(found)]
    plain = naming.default_subnames(spark.createDataFrame(words, "topic int, subtopic int, rank int, term string"))
    told = {t: naming.ask_names(topic_model.words_per_topic(m, spark), template, ask) for t, m in sorted(models.items())} if ask else {}
    asked = spark.createDataFrame([(t, int(k), v) for t, names in told.items() for k, v in sorted(names.items())], "topic int, topic_index bigint, asked string")
    return plain.join(asked, ["topic", "topic_index"], "left").select("topic", "topic_index", F.coalesce("asked", "topic_name").alias("topic_name"))


def run(
    posts: DataFrame, key: str, order: str, folder: str | None = None, mode: str | None = None, topics: int | None = None,
    ask: Callable[[str], str] | None = None, template: str = "{topics}", options: TopicModelOptions = TopicModelOptions(), method: str = "gibbs",
) -> Topics:
    """The whole chain.  ``posts``: site, question_id, type, tokens, normalized_text, a unique ``key`` and the thread's ``order``.

    Every main topic gets a model of the whole threads of its questions, all
    fitted together; one that cannot be fitted is told with the reason, and its
    questions have no subtopic.  With a folder the models and their meta data
    are saved below it.
    """
    require(posts, "site", "question_id", "type", key, order, tokens="array", normalized_text="text")
    spark = posts.sparkSession
    main = fitted(posts, key, mode, topics, options, method)
    if main is None:
        raise ValueError("no topic count could be fitted")
    classified = cut(topic_model.classify_threads(posts, main.model, order))
    subs, failed = topic_model.train_submodels(posts, classified, range(main.topics), key, mode or os.environ.get("LDA_MODE", "search"), options=options, method=method)
    names = named(main.model, spark, ask, template)
    subnames = named_submodels({k: t.model for k, t in subs.items()}, spark, ask, template)
    if folder is not None:
        for name, trial in [("main", main), *((str(k), t) for k, t in sorted(subs.items()))]:
            meta = {"num_topics": trial.topics, "alpha": options.alpha_numerator / trial.topics, "beta": options.beta, "random_seed": options.seed, "coherence": trial.coherence, "perplexity": trial.perplexity}
            trial.model.save(f"{folder.rstrip('/')}/{name}", spark, {k: v for k, v in meta.items() if v is not None})
    questions = topic_model.classify_subtopics(classified, {k: t.model for k, t in subs.items()})
    questions = naming.with_names(questions, names)
    named_subs = subnames.select("topic", F.col("topic_index").alias("subtopic"), F.col("topic_name").alias("subtopic_name"))
    return Topics(main, subs, names, subnames, classified, questions.join(named_subs, ["topic", "subtopic"], "left"), failed)
