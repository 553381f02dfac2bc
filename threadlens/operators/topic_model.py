"""Topic models: dictionary, bag of words, fitting, the sweep over topic counts, submodels, and classification.

Models are fitted by Gibbs sampling, as the study's were, or by variational
inference (``method="variational"``); see lda for both.  A sweep over topic
counts, and the submodels of all topics, are one fit, one scoring and one
coherence job each, however many models there are.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import TopicModelOptions
from ..lineage import remove, scratch
from ..schema import require
from ..sources.tables import write_stage
from . import lda
from .coherence import coherences

log = logging.getLogger(__name__)

#: Terms up to which their shares of topics are sent to all tasks (some 100 bytes each for a few topics).
BROADCAST_TERMS = 1_000_000
METHODS = {"gibbs": lda.gibbs, "variational": lda.variational}


def dictionary(docs: DataFrame, tokens: str = "tokens", options: TopicModelOptions = TopicModelOptions()) -> DataFrame:
    """term, df: terms in enough documents and not too many; the commonest if there are too many terms (with no bound, all).

    Empty documents count in the share, as they do in training.
    """
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = df.where(F.col("df") >= options.min_documents).join(F.broadcast(total)).where(F.col("df") <= F.col("total") * options.max_document_share).select("term", "df")
    return kept if options.vocabulary is None else kept.orderBy(F.col("df").desc(), "term").limit(options.vocabulary)


def dictionaries(docs: DataFrame, corpus: str, tokens: str = "tokens", options: TopicModelOptions = TopicModelOptions()) -> DataFrame:
    """corpus, term, df: dictionary() of each corpus; rows of a null corpus are in none."""
    rows = docs.where(F.col(corpus).isNotNull()).select(F.col(corpus).alias("corpus"), F.col(tokens).alias("tokens"))
    total = rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("total"))
    df = rows.select("corpus", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))
    kept = df.where(F.col("df") >= options.min_documents).join(total, "corpus").where(F.col("df") <= F.col("total") * options.max_document_share)
    if options.vocabulary is None:
        return kept.select("corpus", "term", "df")
    first = Window.partitionBy("corpus").orderBy(F.col("df").desc(), "term")
    return kept.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= options.vocabulary).select("corpus", "term", "df")


def bag_of_words(docs: DataFrame, terms: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """key, term, n: counts of the dictionary's terms; other words are dropped."""
    words = docs.select(key, F.explode(tokens).alias("term"))
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")).join(terms.select("term"), "term", "left_semi").select(key, "term", "n")


def saved_bag_of_words(bow: DataFrame, path: str) -> DataFrame:
    """Writes the counts beside a model's other files and returns them as read back."""
    return write_stage(bow, path)


@dataclass
class TopicModel:
    """A fitted model: terms in order, and for each the weight (counts, or statistics) of each topic."""

    topics: int
    vocabulary: list[str]
    weights: np.ndarray
    alpha: float
    beta: float = 0.01
    _sent: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def of_counts(cls, counts: DataFrame, topics: int, alpha: float, beta: float = 0.01) -> TopicModel:
        """A model from (topic, term, n), such as the counts of another sampler; rows of a cell add up, other topics are left out."""
        cells = counts.where(F.col("topic").between(0, topics - 1) & F.col("term").isNotNull())
        cells = cells.groupBy("term").pivot("topic", list(range(topics))).agg(F.sum("n")).na.fill(0).orderBy("term").toArrow().to_pandas()  # a row a term
        return cls(topics, cells["term"].tolist(), cells[[str(k) for k in range(topics)]].to_numpy(float), alpha, beta)

    @property
    def shares(self) -> np.ndarray:
        """(terms, topics): shares of words in each topic."""
        smoothed = np.asarray(self.weights, float) + self.beta
        return smoothed / smoothed.sum(0) if len(smoothed) else smoothed

    def top_words(self, k: int) -> list[list[tuple[str, float]]]:
        """The k heaviest words of each topic, ties by term."""
        shares, terms = self.shares, np.array(self.vocabulary, object)
        order = np.argsort(terms, kind="stable") if len(terms) else np.zeros(0, int)
        out = []
        for t in range(self.topics):
            first = order[np.argsort(-shares[order, t], kind="stable")[:k]]
            out.append([(terms[i], float(shares[i, t])) for i in first])
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """term, weights: a row for each term."""
        rows = pa.array(list(np.asarray(self.weights, float)), pa.list_(pa.float64()))
        return spark.createDataFrame(pa.table({"term": pa.array(self.vocabulary, pa.string()), "weights": rows}))

    def phi(self, spark: SparkSession) -> DataFrame:
        """topic, term, p: shares of words in each topic; one row a term leaves the driver."""
        total = np.asarray(self.weights, float).sum(0) + self.beta * len(self.vocabulary)
        cells = self.table(spark).select("term", F.posexplode("weights").alias("topic", "w"))
        return cells.select("topic", "term", ((F.col("w") + self.beta) / F.get(F.array(*[F.lit(float(x)) for x in total]), F.col("topic"))).alias("p"))

    def _shipped(self, spark: SparkSession):
        """Terms and shares as sent to the tasks, once for each session."""
        sc = spark.sparkContext
        if sc.applicationId not in self._sent:
            self._sent[sc.applicationId] = sc.broadcast(({t: i for i, t in enumerate(self.vocabulary)}, self.shares, self.alpha))
        return self._sent[sc.applicationId]

    def theta(self, docs: DataFrame, tokens: str = "tokens", known: str | None = None) -> DataFrame:
        """docs with theta: shares of topics in each document, equal ones where no token is known; ``known`` names a flag for that."""
        out = docs.withColumn("_theta", _theta({0: self}, docs.sparkSession)(F.lit(0), F.col(tokens)))
        even = F.array(*[F.lit(1.0 / self.topics)] * self.topics)
        out = out.withColumn("theta", F.coalesce("_theta", even))
        return (out.withColumn(known, F.col("_theta").isNotNull()) if known else out).drop("_theta")

    def save(self, path: str, spark: SparkSession, meta: dict | None = None) -> None:
        self.table(spark).write.mode("overwrite").parquet(f"{path}/weights")
        spark.createDataFrame([(self.topics, float(self.alpha), float(self.beta))], "num_topics int, alpha double, beta double").write.mode("overwrite").parquet(f"{path}/shape")
        if meta:
            spark.createDataFrame([meta]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> TopicModel:
        shape = spark.read.parquet(f"{path}/shape").first()
        rows = spark.read.parquet(f"{path}/weights").orderBy("term").toArrow().to_pandas()  # a row a term: bounded by the dictionary
        weights = np.array(rows["weights"].tolist(), float).reshape(len(rows), shape.num_topics)
        return cls(shape.num_topics, rows["term"].tolist(), weights, shape.alpha, shape.beta)


def _theta(models: dict[int, TopicModel], spark: SparkSession):
    """A function of (number of a model, tokens): shares of its topics, or null where no token is known or no model has the number."""
    sent = {k: m._shipped(spark) for k, m in models.items()}

    @F.pandas_udf("array<double>")
    def shares(model: pd.Series, tokens: pd.Series) -> pd.Series:
        out: list = [None] * len(tokens)
        for k in model.dropna().unique():
            if k not in sent:
                continue
            index, words, alpha = sent[k].value
            at, ids = [], []
            for i in np.flatnonzero((model == k).to_numpy()):
                found = [n for w in (() if tokens.iloc[i] is None else tokens.iloc[i]) if (n := index.get(w)) is not None]
                if found:
                    at.append(i)
                    ids.append(np.array(found, np.int32))
            if not ids:
                continue
            for of, gamma, _ in lda.inferred(ids, words, alpha):
                for i, row in zip(of, gamma / gamma.sum(1, keepdims=True)):
                    out[at[i]] = row.tolist()
        return pd.Series(out, dtype=object)

    return shares


def fit_many(docs: DataFrame, key: str, wanted: dict[int, tuple[int, int]], terms: DataFrame, corpus: str | None = None, tokens: str = "tokens", iterations: int | None = None, options: TopicModelOptions = TopicModelOptions(), method: str = "gibbs") -> Fitted:
    """Fits models in one go.  ``wanted``: model number -> (corpus, topics); ``terms``: corpus, term.

    alpha = 50 / topics for each topic, in training and in inference; beta as
    given.  Results depend neither on partitions nor on the order of rows, as
    long as ``key`` is the same.  A corpus without terms has no models.
    """
    spark = docs.sparkSession
    vocabularies: dict[int, list[str]] = {}
    for r in terms.select("corpus", "term").orderBy("corpus", "term").toArrow().to_pandas().itertuples(index=False):  # bounded by the dictionaries
        vocabularies.setdefault(int(r.corpus), []).append(r.term)
    specs = [lda.Spec(m, c, k, len(vocabularies[c]), options.alpha_numerator / k, options.beta, options.seed) for m, (c, k) in sorted(wanted.items()) if c in vocabularies]
    folder = scratch(spark, "corpus")
    rows = write_stage(lda.spread(lda.encoded(docs, key, tokens, vocabularies, corpus)), folder)
    weights = METHODS[method](rows, specs, iterations or options.iterations) if specs else {}
    models = {s.model: TopicModel(s.topics, vocabularies[s.corpus], weights[s.model], s.alpha, s.beta) for s in specs}
    return Fitted(models, {s.model: s.corpus for s in specs}, rows, folder)


@dataclass
class Fitted:
    """Models, the corpus of each, and the encoded documents they were fitted on (until drop())."""

    models: dict[int, TopicModel]
    corpora: dict[int, int]
    rows: DataFrame
    folder: str

    def drop(self) -> None:
        remove(self.rows.sparkSession, self.folder)

    def perplexities(self) -> dict[int, float | None]:
        """exp(-log-likelihood / words) of each model on its corpus, in one pass; null without words."""
        scored = lda.likelihoods(self.rows, {m: (self.corpora[m], model.shares, model.alpha) for m, model in self.models.items()}, self.rows.sparkSession)
        return {m: float(np.exp(-fit / n)) if n else None for m, (fit, _, n) in scored.items()}


def fit_topics(docs: DataFrame, terms: DataFrame, topics: int, tokens: str = "tokens", iterations: int | None = None, options: TopicModelOptions = TopicModelOptions(), key: str | None = None, method: str = "gibbs") -> TopicModel:
    """Fits one model of the whole table.  Without a ``key`` documents are known by their tokens."""
    if key is None:
        docs, key = docs.select(F.col(tokens), F.array_join(tokens, " ").alias("_key")), "_key"
    fitted = fit_many(docs, key, {0: (0, topics)}, terms.select(F.lit(0).alias("corpus"), "term"), None, tokens, iterations, options, method)
    fitted.drop()
    if not fitted.models:
        return TopicModel(topics, [], np.zeros((0, topics)), options.alpha_numerator / topics, options.beta)
    return fitted.models[0]


def words_per_topic(model: TopicModel, spark: SparkSession, k: int = 20) -> DataFrame:
    """topic, rank, term, weight: the k heaviest words of each topic, ties by term."""
    rows = [(t, r + 1, w, p) for t, words in enumerate(model.top_words(k)) for r, (w, p) in enumerate(words)]
    return spark.createDataFrame(rows, "topic int, rank int, term string, weight double")


def topic_lines(words: DataFrame, decimals: int = 3) -> DataFrame:
    """topic, line: ``Topic 0: [word: "x" weight: (0.123), ...]``."""
    word = F.format_string(f'word: "%s" weight: (%.{decimals}f)', "term", "weight")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", word.alias("s")))), lambda x: x["s"])
    return words.groupBy("topic").agg(listed.alias("l")).select("topic", F.format_string("Topic %d: [%s]", "topic", F.array_join("l", ", ")).alias("line"))


def perplexity(bow: DataFrame, theta: DataFrame, phi: DataFrame, key: str) -> DataFrame:
    """perplexity = exp(-sum n ln(sum over topics of theta * phi) / sum n); null without words.

    theta: key, topic, p.  phi: topic, term, p.  Words of probability zero are
    left out of both sums.
    """
    mixed = bow.join(theta.withColumnRenamed("p", "_t"), key).join(phi.withColumnRenamed("p", "_f"), ["topic", "term"])
    words = mixed.groupBy(key, "term", "n").agg(F.sum(F.col("_t") * F.col("_f")).alias("p")).where("p > 0")
    return words.agg(F.exp(-F.try_divide(F.sum(F.col("n") * F.log("p")), F.sum("n"))).alias("perplexity"))


def perplexity_of_texts(docs: DataFrame, phi: DataFrame, topics: int, tokens: str = "tokens", theta: str = "theta") -> DataFrame:
    """perplexity() of documents that hold their shares of topics: ``theta``, array<double>.  phi: term, shares (array<double>), a row a term.

    Both sums add up word by word, so words need not be counted by document
    first: they meet their term's shares in their rows, and no word is
    shuffled.  phi is counted, so give it as a stage; one of more than
    BROADCAST_TERMS terms is joined by a shuffle of the words.
    """
    shares = phi.select(F.col("term").alias("_term"), F.col("shares").alias("_shares"))
    shares = F.broadcast(shares) if phi.count() <= BROADCAST_TERMS else shares
    words = docs.select(F.col(theta).alias("_theta"), F.explode(tokens).alias("_term")).join(shares, "_term")
    both = [F.coalesce(F.get("_theta", F.lit(k)) * F.get("_shares", F.lit(k)), F.lit(0.0)) for k in range(topics)]
    known = words.select(sum(both[1:], both[0]).alias("p")).where("p > 0")
    return known.agg(F.exp(-F.try_divide(F.sum(F.log("p")), F.count(F.lit(1)))).alias("perplexity"))


def bound_perplexity(model: TopicModel, docs: DataFrame, tokens: str = "tokens") -> float | None:
    """2 ** (-bound / words), the bound of variational inference for the documents given the topics; null without a known word.

    For when perplexity() has no word to work on.
    """
    spark = docs.sparkSession
    if not model.vocabulary:
        return None
    rows = lda.encoded(docs.select(F.col(tokens), F.array_join(tokens, " ").alias("_key")), "_key", tokens, {0: model.vocabulary})
    _, bound, words = lda.likelihoods(rows, {0: (0, model.shares, model.alpha)}, spark)[0]
    return float(2.0 ** (-bound / words)) if words else None


def long_theta(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.posexplode("theta").alias("topic", "p"))


def best_topic(theta: Column) -> tuple[Column, Column]:
    """(index, share) of the largest share; the lowest index of equals."""
    share = F.array_max(theta)
    return (F.array_position(theta, share) - 1).cast("int"), share


@dataclass
class Trial:
    topics: int
    coherence: float
    perplexity: float | None
    model: TopicModel


def evaluate(docs: DataFrame, key: str, wanted: dict[int, tuple[int, int]], terms: DataFrame, corpus: str | None = None, tokens: str = "tokens", iterations: int | None = None, options: TopicModelOptions = TopicModelOptions(), method: str = "gibbs") -> dict[int, Trial]:
    """Fits and scores models: one fit, one pass for perplexity, one job for coherence."""
    fitted = fit_many(docs, key, wanted, terms, corpus, tokens, iterations, options, method)
    tops = {m: (fitted.corpora[m], [[w for w, _ in words] for words in model.top_words(options.top_words)]) for m, model in fitted.models.items()}
    scores, values = coherences(docs, tops, tokens, corpus=corpus), fitted.perplexities()
    fitted.drop()
    out = {}
    for m, model in fitted.models.items():
        value = values[m]
        if value is None:
            own = docs if corpus is None else docs.where(F.col(corpus) == fitted.corpora[m])
            value = bound_perplexity(model, own, tokens)
        out[m] = Trial(model.topics, scores[m], value, model)
    return out


def best_of(trials: Iterable[Trial]) -> Trial | None:
    """The most coherent trial, the one of fewer topics among equals."""
    return min(trials, key=lambda t: (-t.coherence, t.topics), default=None)


def find_best_model(docs: DataFrame, key: str, tokens: str = "tokens", iterations: int | None = None, options: TopicModelOptions = TopicModelOptions(), method: str = "gibbs", strict: bool = False) -> tuple[Trial | None, list[tuple[int, float | None, float | None]]]:
    """Fits every topic count and takes the most coherent, the smaller count of equals.

    Also returns (count, coherence, perplexity) of all counts, for the curves.
    All counts are fitted together; if that fails, they are fitted one by one,
    and a count that fails is logged and has neither figure; with ``strict``,
    or if every count fails, it is raised.  Without a term in the dictionary
    there is no model, and no failure.
    """
    terms = dictionary(docs, tokens, options).select(F.lit(0).alias("corpus"), "term")
    found, errors = _evaluated(docs, key, {k: (0, k) for k in options.topic_counts}, terms, None, tokens, iterations, options, method)
    if errors and (strict or not found):
        raise RuntimeError(f"models of {sorted(errors)} topics failed") from next(iter(errors.values()))
    curve = [(k, found[k].coherence, found[k].perplexity) if k in found else (k, None, None) for k in options.topic_counts]
    return best_of(found.values()), curve


def _evaluated(docs: DataFrame, key: str, wanted: dict[int, tuple[int, int]], *args) -> tuple[dict[int, Trial], dict[int, Exception]]:
    """evaluate(), and where it fails each model by itself; also the errors of those that fail, which the caller must tell or raise."""
    try:
        return evaluate(docs, key, wanted, *args), {}
    except Exception as e:  # noqa: BLE001  one model that cannot be fitted does not end the others
        if len(wanted) == 1:
            log.warning("no model %s: %s", wanted, e)
            return {}, dict.fromkeys(wanted, e)
        log.warning("models are fitted one by one: %s", e)
    out, errors = {}, {}
    for m, spec in wanted.items():
        found, failed = _evaluated(docs, key, {m: spec}, *args)
        out, errors = out | found, errors | failed
    return out, errors


def counts_of(mode: str, topics: int | None, options: TopicModelOptions) -> list[int]:
    """The topic counts to fit: all of the options (``search``), or the given one or their mean (``fixed``)."""
    if mode not in ("search", "fixed"):
        raise ValueError(f"mode {mode!r} is neither search nor fixed")
    return list(options.topic_counts) if mode == "search" else [topics or options.default_topic_count()]


def train(docs: DataFrame, key: str, mode: str = "search", topics: int | None = None, tokens: str = "tokens", iterations: int | None = None, options: TopicModelOptions = TopicModelOptions(), method: str = "gibbs") -> Trial | None:
    """``search`` sweeps all counts; ``fixed`` fits the given count, or the mean of the range.  A count that fails is raised; None without a term."""
    counts = counts_of(mode, topics, options)
    if mode == "search":
        return find_best_model(docs, key, tokens, iterations, options, method, strict=True)[0]
    terms = dictionary(docs, tokens, options).select(F.lit(0).alias("corpus"), "term")
    return evaluate(docs, key, {0: (0, counts[0])}, terms, None, tokens, iterations, options, method).get(0)


def thread_texts(posts: DataFrame, order: str, text: str = "normalized_text") -> DataFrame:
    """site, question_id, text: the non-empty texts of each thread, in row order, joined by blanks."""
    require(posts, "site", "question_id", order, **{text: "text"})
    kept = posts.where(F.col(text).isNotNull() & (F.btrim(F.col(text)) != "") & F.col("site").isNotNull() & F.col("question_id").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return kept.groupBy("site", "question_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("text"))


def classify(texts: DataFrame, model: TopicModel, text: str = "text") -> DataFrame:
    """Adds topic and topic_perc_contrib; null where no word of the text is in the dictionary."""
    docs = texts.withColumn("tokens", F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    index, share = best_topic(F.col("theta"))
    out = model.theta(docs, known="_known").withColumns({"topic": F.when(F.col("_known"), index), "topic_perc_contrib": F.when(F.col("_known"), share)})
    return out.drop("theta", "tokens", "_known")


def classify_threads(posts: DataFrame, model: TopicModel, order: str) -> DataFrame:
    """Posts with topic and topic_perc_contrib on their question rows; other rows and empty threads have null."""
    return on_questions(posts, classify(thread_texts(posts, order), model))


def on_questions(posts: DataFrame, threads: DataFrame) -> DataFrame:
    """Posts with the topic and topic_perc_contrib of their thread (site, question_id) on question rows, null on others."""
    found = threads.select("site", "question_id", F.col("topic").alias("_t"), F.col("topic_perc_contrib").alias("_c"))
    require(posts, "site", "question_id", type="text")
    own = F.col("type") == "question"
    return posts.join(found, ["site", "question_id"], "left").withColumns({"topic": F.when(own, F.col("_t")), "topic_perc_contrib": F.when(own, F.col("_c"))}).drop("_t", "_c")


def subtopic_corpus(posts: DataFrame, classified: DataFrame, topic) -> DataFrame:
    """Whole threads whose question has the topic: the training texts of its submodel."""
    return posts.join(classified.where((F.col("type") == "question") & (F.col("topic") == topic)).select("question_id").distinct(), "question_id", "left_semi")


def corpora_of_topics(posts: DataFrame, classified: DataFrame, into: str = "corpus") -> DataFrame:
    """Whole threads with the topic of their question, as ``into``: the training texts of all submodels.  Threads without a topic are left out."""
    own = classified.where((F.col("type") == "question") & F.col("topic").isNotNull()).select("question_id", F.col("topic").cast("int").alias(into)).distinct()
    return posts.join(own, "question_id")


def train_submodels(posts: DataFrame, classified: DataFrame, topics: Iterable[int], key: str, mode: str = "search", topic_count: int | None = None, tokens: str = "tokens", iterations: int | None = None, options: TopicModelOptions = TopicModelOptions(), method: str = "gibbs") -> tuple[dict[int, Trial], dict[int, str]]:
    """One model for each main topic, on the whole threads of its questions, and for topics without one the reason.

    All submodels, and in search mode all their counts, are fitted together; if
    that fails, one by one, and a model that fails is raised.  Only topics whose
    threads have no term in a dictionary are without a submodel.
    """
    topics, counts = list(topics), counts_of(mode, topic_count, options)
    folder = scratch(posts.sparkSession, "submodels")
    rows = write_stage(corpora_of_topics(posts, classified).where(F.col("corpus").isin(topics)).select("corpus", key, tokens), folder)
    terms = dictionaries(rows, "corpus", tokens, options)
    wanted = {topic * len(counts) + i: (topic, k) for topic in topics for i, k in enumerate(counts)}
    found, errors = _evaluated(rows, key, wanted, terms, "corpus", tokens, iterations, options, method)
    remove(posts.sparkSession, folder)
    if errors:
        raise RuntimeError(f"submodels of (topic, topics) {[wanted[m] for m in sorted(errors)]} failed") from next(iter(errors.values()))
    out, failed = {}, {}
    for topic in topics:
        best = best_of([found[m] for m, (t, _) in wanted.items() if t == topic and m in found])
        if best is not None:
            out[topic] = best
        else:
            failed[topic] = "no term of its threads is in a dictionary"
    for topic, why in failed.items():
        log.warning("no submodel of topic %s: %s", topic, why)
    return out, failed


def classify_subtopics(classified: DataFrame, models: dict[int, TopicModel], text: str = "normalized_text") -> DataFrame:
    """Questions with subtopic and subtopic_perc_contrib from their topic's model, by the question's own text only, in one pass.

    Null without a topic, without a model of it, or without a known word.
    """
    require(classified, "type", "topic", **{text: "text"})
    questions = classified.where("type = 'question'")
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    theta = _theta(models, classified.sparkSession)(F.col("topic"), words) if models else F.lit(None).cast("array<double>")
    return with_subtopics(questions.withColumn("_theta", theta), "_theta").drop("_theta")


def with_subtopics(questions: DataFrame, theta: str) -> DataFrame:
    """Questions with subtopic and subtopic_perc_contrib, the largest share of a column of shares; null where that is null."""
    index, share = best_topic(F.col(theta))
    return questions.withColumns({"subtopic": index, "subtopic_perc_contrib": share})
