import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.config import TopicModelOptions
from threadlens.operators import naming, topic_model
from threadlens.operators import lda
from threadlens.operators.coherence import coherence, coherences, cooccurrence, score_topics, window_counts


def docs_of(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "i int, tokens array<string>")


def test_dictionary_bounds(spark):
    docs = [["five", "half"]] * 5 + [["four", "half"]] * 4 + [["half", "most"]] + [["most"]] * 10
    got = {r.term: r.df for r in topic_model.dictionary(docs_of(spark, docs)).collect()}
    # 20 documents: 10 is exactly half and stays, 11 is more and 4 is too few.
    assert got == {"five": 5, "half": 10}
    bow = topic_model.bag_of_words(docs_of(spark, [["five", "five", "other"], []]), topic_model.dictionary(docs_of(spark, docs)), "i").collect()
    assert [tuple(r) for r in bow] == [(0, "five", 2)]


def test_dictionary_without_a_bound_has_all_terms(spark):
    docs = docs_of(spark, [["a", "b", "c"]] * 5 + [[]] * 6)
    some, every = (TopicModelOptions(vocabulary=n) for n in (2, None))
    assert [r.term for r in topic_model.dictionary(docs, options=some).collect()] == ["a", "b"]
    assert sorted(r.term for r in topic_model.dictionary(docs, options=every).collect()) == ["a", "b", "c"]
    both = docs.withColumn("corpus", F.col("i") % 1)
    assert [topic_model.dictionaries(both, "corpus", options=o).count() for o in (some, every)] == [2, 3]


def test_perplexity(spark):
    bow = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "z", 5)], "i int, term string, n bigint")
    theta = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.75), (2, 0, 1.0)], "i int, topic int, p double")
    phi = spark.createDataFrame([(0, "a", 0.4), (1, "a", 0.2), (0, "b", 0.1), (1, "b", 0.3), (0, "z", 0.0)], "topic int, term string, p double")
    want = math.exp(-(2 * math.log(0.25) + math.log(0.25)) / 3)
    assert abs(topic_model.perplexity(bow, theta, phi, "i").first()[0] - want) < 1e-12
    assert topic_model.perplexity(bow.where("i = 9"), theta, phi, "i").first()[0] is None


def test_perplexity_of_texts_shuffles_no_word(spark, monkeypatch):
    docs = [(1, ["a", "b", "a", "x"], [0.25, 0.75]), (1, ["b"], [0.25, 0.75]), (2, ["z", "z"], [1.0, None]), (3, ["a"], None), (4, None, [0.5, 0.5]), (5, [None, "b"], [1.0])]
    df = spark.createDataFrame(docs, "i int, tokens array<string>, theta array<double>")
    phi = spark.createDataFrame([("a", [0.4, 0.2]), ("b", [0.1, 0.3]), ("z", [0.0, 0.5])], "term string, shares array<double>")
    want = math.exp(-(4 * math.log(0.25) + math.log(0.1)) / 5)
    for most in (topic_model.BROADCAST_TERMS, 0):  # terms are sent to the tasks, or joined
        monkeypatch.setattr(topic_model, "BROADCAST_TERMS", most)
        got = topic_model.perplexity_of_texts(df, phi, 2)
        assert abs(got.first()[0] - want) < 1e-12
        assert ("hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()) or not most
        assert topic_model.perplexity_of_texts(df.where("i = 4"), phi, 2).first()[0] is None


def test_windows():
    n, ids, both = window_counts(list("abcab"), {"a": 0, "c": 1, "x": 2}, 2)
    # Windows: ab bc ca ab.
    assert n == 4 and ids.tolist() == [0, 1] and both.tolist() == [[3, 1], [1, 2]]
    assert window_counts(["a"], {"a": 0}, 110)[0] == 1


def test_windows_match_brute_force():
    terms = {"a": 0, "b": 1, "c": 4}
    for size, window in [(0, 3), (2, 5), (5, 5), (40, 1), (57, 6), (300, 20), (120, 110)]:
        tokens = list(np.random.default_rng(size).choice(list("abcdef"), size))
        n, ids, both = window_counts(tokens, terms, window)
        seen = [{terms[w] for w in tokens[s : s + window] if w in terms} for s in range(max(1, size - window + 1))]
        assert n == len(seen) and list(ids) == sorted(set().union(*seen))
        assert both.tolist() == [[sum({i, j} <= s for s in seen) for j in ids] for i in ids]


def test_coherence_orders_topics(spark):
    docs = docs_of(spark, [list("abcd")] * 30 + [list("wxyz")] * 30)
    good, bad = coherence(docs, [list("abc"), list("xyz")]), coherence(docs, [list("awb"), list("xcy")])
    assert good > 0.99 and bad < good
    assert score_topics([[0, 1]], np.array([[4.0, 0.0], [0.0, 4.0]]), 8)[0] < 0.8


def test_coherences_of_many_models_are_those_of_each(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 2), list(rng.choice(list("abcdefgh"), rng.integers(0, 260)))) for i in range(40)] + [(90, 0, None), (91, None, ["a", "b"])]
    docs = spark.createDataFrame(rows, "i int, c int, tokens array<string>")
    models = {7: (0, [list("abc"), list("cde")]), 8: (1, [list("abh")]), 9: (0, [list("gh"), list("ab"), list("xyz")]), 10: (5, [list("ab")])}
    got = coherences(docs, models, corpus="c")
    for m, (c, topics) in models.items():
        assert got[m] == pytest.approx(coherence(docs.where(f"c = {c}"), topics) if c < 5 else 0.0, abs=1e-12)
    assert coherences(docs, {}) == {}
    some = [r for r in rows if r[2]]
    held = [{w for w in r[2][s : s + 110]} for r in some for s in range(max(1, len(r[2]) - 109))]
    counted = {(r.i, r.j): r.n for r in cooccurrence(docs, ["h", "a", "z"]).collect()}
    assert counted == {(-1, -1): len(held), (0, 0): sum("h" in s for s in held), (1, 1): sum("a" in s for s in held), (0, 1): sum({"a", "h"} <= s for s in held)}


@pytest.fixture(scope="module")
def corpus(spark):
    left, right = ["key", "cipher", "block", "mode"], ["login", "user", "password", "hash"]
    docs = [[left[(k + j) % 4] for j in range(6)] for k in range(20)] + [[right[(k + j) % 4] for j in range(6)] for k in range(20)] + [[]]
    return docs_of(spark, docs).cache()


OPTIONS = TopicModelOptions(topic_counts=(1, 2), min_documents=2.0, max_document_share=0.9, alpha_numerator=0.2, top_words=4)


def test_sweep_and_classification(spark, corpus, tmp_path):
    best, curve = topic_model.find_best_model(corpus, "i", iterations=20, options=OPTIONS)
    assert [c[0] for c in curve] == [1, 2] and best.topics == 2 and best.coherence >= curve[0][1]
    assert best.perplexity < curve[0][2]
    words = topic_model.words_per_topic(best.model, spark, 4)
    tops = [{r.term for r in words.where(f"topic = {t}").collect()} for t in (0, 1)]
    assert {"key", "cipher", "block", "mode"} in tops
    names = {r.topic_index: r.topic_name for r in naming.default_names(words).collect()}
    assert len(names) == 2 and all(len(n.split(", ")) == 3 for n in names.values())
    posts = spark.createDataFrame(
        [("s", "1", "question", 1, "key cipher"), ("s", "1", "answer", 2, "block mode key"), ("s", "2", "question", 1, "user login"), ("s", "3", "question", 1, None), ("s", "4", "question", 1, "unheard words"), (None, "5", "question", 1, "key")],
        "site string, question_id string, type string, pos int, normalized_text string",
    )
    texts = {r.question_id: r.text for r in topic_model.thread_texts(posts, "pos").collect()}
    assert texts == {"1": "key cipher block mode key", "2": "user login", "4": "unheard words"}
    best.model.save(f"{tmp_path}/m", spark, {"num_topics": 2, "coherence": 0.5})
    again = topic_model.TopicModel.load(f"{tmp_path}/m", spark)
    done = topic_model.classify_threads(posts, again, "pos")
    got = {(r.question_id, r.type): r.topic for r in done.collect()}
    crypto = [k for k in (0, 1) if "key" in tops[k]][0]
    assert got == {("1", "question"): crypto, ("1", "answer"): None, ("2", "question"): 1 - crypto, ("3", "question"): None, ("4", "question"): None, ("5", "question"): None}
    subs = {r.question_id: r.subtopic for r in topic_model.classify_subtopics(done, {crypto: again}).collect()}
    assert subs == {"1": crypto, "2": None, "3": None, "4": None, "5": None}
    assert {r.question_id for r in topic_model.subtopic_corpus(posts, done, crypto).collect()} == {"1"}


def test_bound_perplexity(spark, corpus):
    terms = topic_model.dictionary(corpus, options=OPTIONS)
    two = topic_model.fit_topics(corpus, terms, 2, iterations=5, options=OPTIONS)
    value = topic_model.bound_perplexity(two, corpus)
    assert math.isfinite(value) and value > 1
    assert topic_model.bound_perplexity(two, corpus.where("size(tokens) = 0")) is None
    assert topic_model.bound_perplexity(two, docs_of(spark, [["unknown", "words"]])) is None
    # With one topic the bound is the likelihood itself.
    one = topic_model.fit_topics(corpus, terms, 1, options=OPTIONS)
    p = dict(zip(one.vocabulary, one.shares[:, 0]))
    words = [w for r in corpus.collect() for w in r.tokens]
    assert topic_model.bound_perplexity(one, corpus) == pytest.approx(2 ** -(sum(math.log(p[w]) for w in words) / len(words)), rel=1e-6)
    # The bound is below the likelihood: its perplexity, with the same base, is not smaller.
    fitted = topic_model.fit_many(corpus, "i", {0: (0, 2)}, terms.selectExpr("0 AS corpus", "term"), iterations=5, options=OPTIONS)
    fit, bound, n = lda.likelihoods(fitted.rows, {0: (0, fitted.models[0].shares, 0.1)}, spark)[0]
    assert n == 240 and bound <= fit < 0


def test_failing_count_does_not_end_the_sweep(corpus, monkeypatch):
    real = topic_model.evaluate
    monkeypatch.setattr(topic_model, "evaluate", lambda docs, key, wanted, *a: 1 / 0 if 2 in wanted else real(docs, key, wanted, *a))
    best, curve = topic_model.find_best_model(corpus, "i", iterations=2, options=OPTIONS)
    assert best.topics == 1 and curve[0][1] is not None and curve[1] == (2, None, None)


def test_failures_are_no_results(spark, corpus, monkeypatch):
    real, posts = topic_model.evaluate, corpus.selectExpr("i AS question_id", "i", "'question' AS type", "tokens")
    classified = posts.withColumn("topic", F.col("i") % 2)
    submodels = lambda: topic_model.train_submodels(posts, classified, range(3), "i", "fixed", 2, iterations=2, options=OPTIONS)
    subs, failed = submodels()
    assert set(subs) == {0, 1} and list(failed) == [2] and "no term" in failed[2]
    monkeypatch.setattr(topic_model, "evaluate", lambda docs, key, wanted, *a: 1 / 0 if len(wanted) > 1 or 1 in wanted else real(docs, key, wanted, *a))
    with pytest.raises(RuntimeError, match=r"\[\(1, 2\)\] failed"):
        submodels()
    for search in (lambda: topic_model.find_best_model(corpus, "i", iterations=2, options=OPTIONS, strict=True), lambda: topic_model.train(corpus, "i", iterations=2, options=OPTIONS)):
        with pytest.raises(RuntimeError, match=r"\[1\] topics failed"):
            search()
    monkeypatch.setattr(topic_model, "evaluate", lambda *a: 1 / 0)
    with pytest.raises(RuntimeError, match=r"\[1, 2\] topics failed"):
        topic_model.find_best_model(corpus, "i", options=OPTIONS)


def test_equal_coherence_takes_the_smaller_count(corpus, monkeypatch):
    monkeypatch.setattr(topic_model, "evaluate", lambda docs, key, wanted, *a: {k: topic_model.Trial(k, 0.5, None, None) for k in wanted})
    assert topic_model.find_best_model(corpus, "i", options=OPTIONS)[0].topics == 1


# --- fitting ---


def drawn(seed, docs=120, words=40, topics=3, terms=60):
    """Documents of a known model: each topic has a third of the terms, documents mostly one topic."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(docs):
        theta = rng.dirichlet([0.2] * topics)
        z = rng.choice(topics, words, p=theta)
        out.append([f"w{k * (terms // topics) + rng.integers(terms // topics):03d}" for k in z])
    return out


def sequential_gibbs(docs, topics, alpha, beta, rounds, seed):
    """The textbook sampler, token by token: counts (terms, topics)."""
    rng = np.random.default_rng(seed)
    terms = sorted({w for d in docs for w in d})
    ids = [[terms.index(w) for w in d] for d in docs]
    z = [list(rng.integers(topics, size=len(d))) for d in ids]
    kw, dk = np.zeros((len(terms), topics)), np.zeros((len(docs), topics))
    for d, (words, zs) in enumerate(zip(ids, z)):
        for w, k in zip(words, zs):
            kw[w, k] += 1
            dk[d, k] += 1
    total = kw.sum(0)
    for _ in range(rounds):
        for d, words in enumerate(ids):
            for t, w in enumerate(words):
                k = z[d][t]
                kw[w, k] -= 1
                dk[d, k] -= 1
                total[k] -= 1
                p = np.cumsum((dk[d] + alpha) * (kw[w] + beta) / (total + len(terms) * beta))
                k = z[d][t] = int(np.searchsorted(p, rng.random() * p[-1], side="right"))
                kw[w, k] += 1
                dk[d, k] += 1
                total[k] += 1
    return terms, kw


def perplexity_of(docs, terms, weights, alpha, beta):
    shares = (weights + beta) / (weights + beta).sum(0)
    at = {t: i for i, t in enumerate(terms)}
    fit = n = 0
    for _, gamma, bag in lda.inferred([np.array([at[w] for w in d], np.int32) for d in docs], shares, alpha):
        fit, n = fit + lda.fits(gamma, *bag, shares, alpha)[0].sum(), n + bag[1].sum()
    return math.exp(-fit / n)


FEW = TopicModelOptions(min_documents=1.0, max_document_share=1.0, alpha_numerator=0.6)


def test_gibbs_is_as_good_as_a_sequential_sampler(spark):
    docs = drawn(1)
    terms, kw = sequential_gibbs(docs, 3, 0.2, 0.01, 40, 5)
    df = docs_of(spark, docs)
    model = topic_model.fit_topics(df, topic_model.dictionary(df, options=FEW), 3, iterations=40, options=FEW, key="i")
    assert model.vocabulary == terms and model.weights.sum() == 120 * 40 and model.weights.min() >= 0
    assert (model.weights.sum(1) == kw.sum(1)).all()
    ours, theirs = perplexity_of(docs, terms, model.weights, 0.2, 0.01), perplexity_of(docs, terms, kw, 0.2, 0.01)
    assert abs(ours / theirs - 1) < 0.02
    # Topics are those the documents were drawn from.
    tops = {frozenset(w for w, _ in t) for t in model.top_words(20)}
    assert tops == {frozenset(f"w{k:03d}" for k in range(b, b + 20)) for b in (0, 20, 40)}


@pytest.mark.parametrize("method", ["gibbs", "variational"])
def test_fits_do_not_depend_on_partitions(spark, method):
    docs = docs_of(spark, [*drawn(2, 60), [], None])
    terms = topic_model.dictionary(docs, options=FEW)
    fits = [topic_model.fit_topics(docs.repartition(n).sortWithinPartitions(F.rand(n)), terms, 4, iterations=12, options=FEW, key="i", method=method) for n in (1, 4, 16)]
    for other in fits[1:]:
        assert other.vocabulary == fits[0].vocabulary
        assert np.array_equal(other.weights, fits[0].weights)


def test_variational_topics(spark):
    docs = drawn(3)
    df = docs_of(spark, docs)
    model = topic_model.fit_topics(df, topic_model.dictionary(df, options=FEW), 3, iterations=60, options=FEW, key="i", method="variational")
    terms, kw = sequential_gibbs(docs, 3, 0.2, 0.01, 40, 5)
    assert perplexity_of(docs, terms, model.weights, 0.2, 0.01) < 1.05 * perplexity_of(docs, terms, kw, 0.2, 0.01)


def test_posterior_is_a_fixed_point():
    rng = np.random.default_rng(5)
    words = rng.dirichlet(np.ones(9), 3).T
    bag = lda.bags([np.array([0, 1, 1, 8], np.int32), np.array([5] * 6, np.int32)])
    gamma = lda.posterior(*bag, words, 0.3, 500)
    assert np.allclose(gamma, lda.posterior(*bag, words, 0.3, 501), atol=1e-9) and np.allclose(gamma.sum(1), [4 + 0.9, 6 + 0.9])
    assert np.allclose(lda.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525890], atol=1e-9)


def test_many_models_are_those_fitted_alone(spark, monkeypatch):
    docs = [(i, i % 2, d) for i, d in enumerate(drawn(6, 60))]
    df = spark.createDataFrame(docs, "i int, c int, tokens array<string>")
    terms = topic_model.dictionaries(df, "c", options=FEW)
    wanted = {0: (0, 2), 1: (0, 3), 2: (1, 2), 3: (1, 1), 4: (7, 2)}
    together = topic_model.fit_many(df, "i", wanted, terms, "c", iterations=10, options=FEW)
    monkeypatch.setattr(lda, "MAX_CELLS", 150)  # fitted in turns
    split = topic_model.fit_many(df, "i", wanted, terms, "c", iterations=10, options=FEW)
    assert set(together.models) == {0, 1, 2, 3}
    values = together.perplexities()
    for m, model in together.models.items():
        assert np.array_equal(model.weights, split.models[m].weights)
        own = df.where(f"c = {wanted[m][0]}")
        alone = topic_model.fit_many(own, "i", {m: (0, wanted[m][1])}, topic_model.dictionary(own, options=FEW).selectExpr("0 AS corpus", "term"), iterations=10, options=FEW)
        assert np.array_equal(alone.models[m].weights, model.weights)
        bow = topic_model.bag_of_words(own, topic_model.dictionary(own, options=FEW), "i")
        plain = topic_model.perplexity(bow, topic_model.long_theta(model.theta(own), "i"), model.phi(spark), "i").first()[0]
        assert values[m] == pytest.approx(plain, rel=1e-5)


def test_a_sweep_scans_the_corpus_a_fixed_number_of_times(spark):
    """Jobs of a sweep don't grow with the number of topic counts."""
    df = docs_of(spark, drawn(7, 40))
    jobs = []
    for counts in ((1, 2), tuple(range(1, 26))):
        spark.sparkContext.setJobGroup(f"sweep{len(counts)}", "")
        best, curve = topic_model.find_best_model(df, "i", iterations=10, options=TopicModelOptions(topic_counts=counts, min_documents=1.0, max_document_share=1.0))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sweep{len(counts)}")))
        assert len(curve) == len(counts) and best.topics in counts and all(c is not None and p > 1 for _, c, p in curve)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2


def test_submodels_in_one_fit(spark):
    docs = drawn(8, 60)
    posts = spark.createDataFrame([(str(q), "question" if t == 0 else "answer", f"{q}/{t}", docs[(q * 2 + t) % 60], " ".join(docs[(q * 2 + t) % 60])) for q in range(30) for t in range(2)], "question_id string, type string, key string, tokens array<string>, normalized_text string")
    classified = posts.withColumn("topic", F.when(posts.type == "question", (posts.question_id % 3).cast("int"))).withColumn("topic_perc_contrib", F.lit(0.5))
    options = TopicModelOptions(topic_counts=(2, 3), min_documents=1.0, max_document_share=1.0, alpha_numerator=0.6)
    subs, failed = topic_model.train_submodels(posts, classified, range(4), "key", iterations=10, options=options)
    assert set(subs) == {0, 1, 2} and list(failed) == [3] and "no term" in failed[3]
    own = topic_model.subtopic_corpus(posts, classified, 1)
    alone, none = topic_model.train_submodels(own, classified, [1], "key", iterations=10, options=options)
    assert none == {} and (alone[1].topics, alone[1].coherence) == (subs[1].topics, pytest.approx(subs[1].coherence))
    out = topic_model.classify_subtopics(classified, {k: t.model for k, t in subs.items() if k != 2}).collect()
    assert len(out) == 30
    for r in out:
        assert (r.subtopic is None) == (r.topic == 2) and r.topic_perc_contrib == 0.5
        if r.topic != 2:
            theta = subs[r.topic].model.theta(spark.createDataFrame([(r.tokens,)], "tokens array<string>")).first().theta
            assert r.subtopic == int(np.argmax(theta)) and r.subtopic_perc_contrib == pytest.approx(max(theta))


def test_no_terms_no_models(spark):
    docs = docs_of(spark, [["a"], [], None])
    assert topic_model.find_best_model(docs, "i", iterations=2) == (None, [(k, None, None) for k in range(1, 26)])
    assert topic_model.train(docs, "i", "fixed", 2, iterations=2) is None
    assert topic_model.fit_topics(docs, topic_model.dictionary(docs), 2, iterations=2).vocabulary == []


def test_best_topic_takes_the_first(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],)], "t array<double>")
    index, share = topic_model.best_topic(F.col("t"))
    assert [tuple(r) for r in df.select(index, share).collect()] == [(0, 0.4), (2, 0.7)]


def test_names(spark):
    assert naming.parse_names({"topics": [{"topic_index": 0, "topic_name": "a"}, {"topic_id": "1", "inferred_name": "b"}, {"x": 1}]}) == {0: "a", 1: "b"}
    words = spark.createDataFrame([(0, 1, "w", 0.5)], "topic int, rank int, term string, weight double")
    seen = []
    assert naming.ask_names(words, "name: {topics}", lambda p: seen.append(p) or '{"topics": [{"topic_index": 0, "topic_name": "z"}]}') == {0: "z"}
    assert seen == ['name: Topic 0: [word: "w" weight: (0.500000)]']
    assert naming.ask_names(words, "{topics}", lambda p: "no json") == {}
    df = naming.with_names(spark.createDataFrame([(0,), (7,), (None,)], "topic int"), spark.createDataFrame([(0, "zero")], "topic_index int, topic_name string"))
    assert sorted(((r.topic, r.topic_name) for r in df.collect()), key=str) == [(0, "zero"), (7, "7"), (None, None)]


def test_fixed_mode_uses_the_mean_count():
    assert TopicModelOptions().default_topic_count() == 13


def test_large_dictionaries_classify_like_small_ones(spark):
    """One rule: a text without a known word has no topic, however many terms there are."""
    for size in (30, 2_500):
        words = [f"w{k}" for k in range(size)]
        docs = spark.createDataFrame([(k, words[k::7] * 2) for k in range(7)] + [(9, words)], "i int, tokens array<string>")
        terms = spark.createDataFrame([(w, 2) for w in words], "term string, df bigint")
        for topics in (1, 2):
            model = topic_model.fit_topics(docs, terms, topics, iterations=2)
            texts = spark.createDataFrame([(1, "nothing known here"), (2, f"here w3 {words[-1]}"), (3, None), (4, "")], "id int, text string")
            got = {r.id: (r.topic, r.topic_perc_contrib) for r in topic_model.classify(texts, model).collect()}
            assert got[1] == got[3] == got[4] == (None, None) and got[2][0] in range(topics) and got[2][1] > 0


def test_a_document_is_one_row_for_all_models(spark):
    rows = spark.createDataFrame([(0, k, [k % 5, 1, 1, 4]) for k in range(50)] + [(1, 99, [0, 1])], "corpus int, uid bigint, ids array<int>").coalesce(1)
    specs = [lda.Spec(m, c, k, 5, 0.1, 0.01, 7) for m, (c, k) in enumerate([(0, 1), (0, 3), (0, 7), (1, 2)])]
    got = lda._step(rows, specs, None, 0, 0).collect()
    docs, changes = [r for r in got if r.kind == 0], [r for r in got if r.kind == 1]
    assert len(docs) == 51 and {(r.corpus, len(r.z)) for r in docs} == {(0, 8), (1, 2)}  # no topics are kept of a model of one
    assert len(changes) == len({(r.model, r.cell) for r in changes})  # summed over the task
    totals = {m: sum(r.n for r in changes if r.model == m) for m in range(4)}
    assert totals == {0: 200, 1: 200, 2: 200, 3: 2}


def test_changes_are_added_up_by_block(spark, monkeypatch):
    """What tasks say of the counts is a row a block, not a row a cell."""
    monkeypatch.setattr(lda, "BLOCK", 4)
    rng = np.random.default_rng(4)
    found = [(m, rng.integers(-1, 2, 11)) for m in (0, 1, 0, 1, 0)]
    rows = [r for m, x in found for batch in lda._changes(m, x) for r in batch.to_pylist()]
    assert len(rows) <= 5 * 3 and sum(r["n"] for r in rows) == sum(int(x.sum()) for _, x in found)
    sums = {m: np.zeros(11, np.int64) for m in (0, 1)}
    for batch in lda._changes(7, np.arange(6), 40):
        assert batch.to_pylist()[0]["cell"] in (40, 44)
    got = lda._summed(spark.createDataFrame([{k: r[k] for k in ("model", "cell", "places", "changes")} for r in rows], "model int, cell bigint, places array<int>, changes array<bigint>").repartition(3)).toArrow()
    for (m, cell), places, changes in lda._blocks(got):
        sums[m][cell : cell + 4][places] += changes
    assert all(np.array_equal(sums[m], sum(x for k, x in found if k == m)) for m in (0, 1))


def test_queries_of_models_run_the_rounds_of_the_study(spark, sf_dir, monkeypatch):
    from threadlens.plans import catalog

    asked = []
    fit = lambda docs, key, wanted, terms, corpus, tokens, iterations, options, method: asked.append((sorted(wanted.values()), iterations or options.iterations)) or {m: topic_model.Trial(k, 0.5, 1.0, None) for m, (_, k) in wanted.items()}
    monkeypatch.setattr(topic_model, "evaluate", fit)
    for name in ("g13_fixed_model", "g8_best_model"):
        catalog.QUERIES[name](spark, sf_dir)
    assert asked == [([(0, 13)], 2000), ([(0, k) for k in range(1, 26)], 2000)]


def test_known_words_are_numbered_in_order():
    pa = lda.pa
    texts = pa.array([["b", "x", "a", "b"], None, [], ["x"], ["a", None]], pa.list_(pa.string()))
    want = [[1, 0, 1], [], [], [], [0]]
    assert lda.known_ids(texts, pa.array(["a", "b"])).to_pylist() == want
    assert lda.known_ids(texts.slice(2, 3), pa.array(["a", "b"])).to_pylist() == want[2:]


def test_encoded_documents_are_dealt_out(spark):
    rows = spark.createDataFrame([(0, k, [1]) for k in range(500)], "corpus int, uid bigint, ids array<int>").coalesce(1)
    assert lda.spread(rows).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
