import math
import random
import re
import zlib

import numpy as np
import pytest
from helpers import documents

from threadlens.llm import quality, toxicity


def held(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for k in range(500):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 300))]
        good, toxic = int(k % 4 != 0), int(k % 5 == 0)
        if not good:
            words = [w.upper() + "!!" for w in words] if k % 8 else words[:3] * 40
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "Rotten", "scum"]))
        docs.append((k, " ".join(words)))
        labels.append((k, good, toxic))
    return docs, labels


def test_quality_on_held_out_documents(spark, corpus):
    docs, labels = documents(spark, corpus[0]), labelled(spark, corpus[1])
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == 500
    right = [got[i].predicted == q for i, q, _ in corpus[1] if held(i, 3, 1)]
    assert all(got[i].held_out == held(i, 3, 1) for i, *_ in corpus[1]) and np.mean(right) >= 0.95
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_gradient():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 6, 9)
    x, starts = quality.Bag(rng.standard_normal((9, 5)), rng.integers(0, 7, counts.sum()), counts), np.array([0, 4, 5])
    p = {"E": rng.standard_normal((7, 4)), "W": rng.standard_normal((9, 3)), "c": rng.standard_normal(3), "V": rng.standard_normal((3, 2)), "U": rng.standard_normal((3, 2)), "w": rng.standard_normal(2), "o": rng.standard_normal(3), "d": np.array(0.3)}
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        out = quality._forward(p, x, starts)["p"]
        return -(weight * (y * np.log(out) + (1 - y) * np.log(1 - out))).sum()

    g = quality._backward(p, x, starts, quality._forward(p, x, starts), y, weight)
    for k, a in p.items():
        flat = a.reshape(-1)
        for j in range(0, flat.size, max(1, flat.size // 4)):
            kept = flat[j]
            flat[j] = kept + 1e-6
            up = loss()
            flat[j] = kept - 1e-6
            down = loss()
            flat[j] = kept
            assert abs((up - down) / 2e-6 - np.reshape(g[k], -1)[j]) < 1e-4


def brute_quality(text, model):
    """The score of one text, passage by passage and number by number."""
    p, ws = model.layers, text.encode("utf-8", "replace").split()
    encoded, energy = [], []
    for at in range(0, max(1, len(ws)), quality.PASSAGE):
        part = ws[at : at + quality.PASSAGE]
        marks = [b for w in part for b in (zlib.crc32(w.lower()) % 2048, zlib.crc32(w.lower()[-3:], 1) % 2048)] or [2048]
        surface = quality.passages(b" ".join(part).decode()).x[0]
        x = [*((surface - model.mean) / model.std), *(sum(p["E"][m, k] for m in marks) / len(marks) for k in range(quality.EMBEDDING))]
        h = [math.tanh(sum(v * p["W"][i, j] for i, v in enumerate(x)) + p["c"][j]) for j in range(quality.HIDDEN)]
        gates = [math.tanh(sum(v * p["V"][i, j] for i, v in enumerate(h))) / (1 + math.exp(-sum(v * p["U"][i, j] for i, v in enumerate(h)))) for j in range(quality.GATE)]
        encoded.append(h)
        energy.append(math.exp(sum(g * w for g, w in zip(gates, p["w"]))))
    mixed = [sum(e * h[j] for e, h in zip(energy, encoded)) / sum(energy) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(v * w for v, w in zip(mixed, p["o"])) - p["d"]))


def test_quality_scores_match_brute_force(spark, corpus, edge_rows):
    model = quality.train(documents(spark, corpus[0]), labelled(spark, corpus[1]), rows=120, epochs=2)
    rows = corpus[0][:12] + [(1000 + k, t) for k, (_, t, _) in enumerate(edge_rows)]
    got = {r.doc_id: r.score for r in quality.score(documents(spark, rows), model).collect()}
    assert all(abs(got[k] - brute_quality(t or "", model)) < 1e-9 for k, t in rows)


def test_quality_learns_words_that_surface_features_miss():
    """Good and bad passages hold words of the same lengths and letters."""
    rng = random.Random(4)
    good, bad = ["stone", "lemon", "trial", "angel"], ["notes", "melon", "trail", "angle"]
    texts = [" ".join(rng.choice(good if k % 2 else bad) for _ in range(60)) for k in range(200)]
    model = quality.fit([quality.passages(t) for t in texts[:100]], np.arange(100) % 2)
    got = quality._score_texts(texts[100:], model)
    assert np.mean((got >= 0.5) == np.arange(100) % 2) >= 0.95


def test_every_passage_of_a_fitting_text_counts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels, epochs: seen.extend(len(b.x) for b in bags))
    rows = [(k, "word " * (128 * 60 + 1)) for k in range(6)]
    rows += rows[:2]  # repeated ids are learned once
    quality.train(documents(spark, rows), labelled(spark, [(k, k % 2, 0) for k in range(6)]))
    use = [k for k in range(6) if not held(k, 3, 1)]
    assert seen == [61] * len(use)
    seen.clear()
    quality.train(documents(spark, rows), labelled(spark, [(k, k % 2, 0) for k in range(6)]), words=2 * (128 * 60 + 1))
    assert seen == [61] * 2


def brute_toxicity(text, model):
    found = set(re.findall(r"[^\W\d_]+", text.lower()))
    found |= {w[:k] + "-" for w in found for k in (4, 5) if len(w) > k}
    return 1 / (1 + math.exp(-model.bias - sum(w for f, w in model.weights.items() if f in found)))


def test_toxicity_scores_match_brute_force(spark, corpus, edge_rows):
    model = toxicity.train(documents(spark, corpus[0]), labelled(spark, corpus[1]))
    rows = corpus[0][:40] + [(1000 + k, t) for k, (_, t, _) in enumerate(edge_rows)]
    got = {r.doc_id: r.score for r in toxicity.score(documents(spark, rows), model).collect()}
    assert model.weights and all(abs(got[k] - brute_toxicity(t or "", model)) < 1e-9 for k, t in rows)


def test_toxicity_fit_is_the_optimum_of_its_objective():
    """Against plain gradient descent on the penalised loss of a tiny set, written out feature by feature."""
    texts = ["vile man", "vile woman", "kind man", "kind woman", "vile thing", "kind thing", "vile man here", "kind man here"] * 2
    y = np.array([1, 1, 0, 0, 1, 0, 1, 0] * 2, float)
    pairs = [p for t in texts for p in toxicity.swaps(t)]
    model = toxicity.fit([toxicity.words(t) for t in texts], y, pairs, l1=0.0, counterfactual=0.5, rounds=3000)
    feats = [toxicity.with_stems(toxicity.words(t)) for t in texts]
    names = sorted({f for fs in feats for f in fs})
    odds = {f: math.log((sum(f in fs for fs, v in zip(feats, y) if v) + 0.5) / (y.sum() + 1)) - math.log((sum(f in fs for fs, v in zip(feats, y) if not v) + 0.5) / (len(y) - y.sum() + 1)) for f in names}
    names = [f for f in names if sum(f in fs for fs in feats) >= 4 and abs(odds[f]) >= 0.5]

    def loss(m):
        out = 0.0
        for fs, v in zip(feats, y):
            z = m.bias + sum(m.weights.get(f, 0.0) for f in fs)
            out += (math.log1p(math.exp(-z)) if v else math.log1p(math.exp(z))) / len(y)
        for a, b in pairs:
            change = sum(m.weights.get(f, 0.0) for f in toxicity.with_stems(toxicity.words(b))) - sum(m.weights.get(f, 0.0) for f in toxicity.with_stems(toxicity.words(a)))
            out += 0.5 * change**2 / len(pairs)
        return out

    assert set(model.weights) <= set(names) and "vile" in model.weights
    best = loss(model)
    for f in [None, *names]:  # no small step along any weight lowers the loss by more than rounding
        for step in (1e-3, -1e-3):
            moved = toxicity.Model(model.bias + step * (f is None), model.weights | ({f: model.weights.get(f, 0.0) + step} if f else {}))
            assert loss(moved) >= best - 5e-5


def test_toxicity_on_held_out_documents(spark, corpus):
    docs, labels = documents(spark, corpus[0]), labelled(spark, corpus[1])
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    out = [(got[i].predicted, t) for i, _, t in corpus[1] if held(i, 4, 2)]
    assert all(got[i].held_out == held(i, 4, 2) for i, *_ in corpus[1])
    assert np.mean([p == t for p, t in out]) >= 0.95
    assert np.mean([p for p, t in out if t]) >= 0.95


def test_counterfactuals_lower_false_positives():
    rng = random.Random(2)
    texts, labels = [], []
    for k in range(400):
        toxic = k % 2
        # In the sample one group is named mostly in toxic sentences.
        group = "muslim" if rng.random() < (0.8 if toxic else 0.05) else rng.choice(["hindu", "christian", ""])
        texts.append(f"the {group} people {rng.choice(['came', 'left', 'ate'])} {rng.choice(['vile', 'scum', 'rotten']) if toxic and rng.random() < 0.6 else 'here'}")
        labels.append(toxic)
    pairs = [p for t in texts for p in toxicity.swaps(t)]
    sets = [toxicity.words(t) for t in texts]
    plain = toxicity.fit(sets, np.array(labels), pairs, counterfactual=0.0)
    fair = toxicity.fit(sets, np.array(labels), pairs)
    neutral, other = "the muslim people came here", "the hindu people came here"
    gap = lambda m: abs(m.score(neutral) - m.score(other))
    assert gap(plain) > 0.3 and gap(fair) < 0.1 and fair.score(neutral) < plain.score(neutral)
    assert fair.score("the hindu people are vile scum") > 0.5


def test_all_sentences_count_as_counterfactuals(spark, monkeypatch):
    """Terms named after 20,000 pairs, and in sentences of more than 100 words, count too."""
    rows = [(k, "old man. " * 1500) for k in range(8)] + [(100 + k, "a muslim came " + "here " * 150) for k in range(8)]
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, pairs, **options: seen.append(pairs))
    toxicity.train(documents(spark, rows), labelled(spark, [(k, 1, k % 2) for k, _ in rows]))
    used = [t for k, t in rows if not held(k, 4, 2)]
    want = toxicity.Counter(toxicity._change(toxicity.words(a), toxicity.words(b)) for t in used for a, b in toxicity.swaps(t))
    assert seen == [want] and sum(want.values()) > 20_000
    assert any("muslim" in c.split("\t")[0] for c in want)


def test_changes_count_the_swaps():
    for text in ("Old men, black_1 black black1; the blackest man!", "a muslim and a hindu\tmuslims 中文 white.white", "", "GAY straight"):
        want = toxicity.Counter(toxicity._change(toxicity.words(a), toxicity.words(b)) for a, b in toxicity.swaps(text))
        assert toxicity.changes(text) == want


@pytest.mark.parametrize("op", [quality, toxicity])
def test_edges(spark, edge_rows, op):
    docs = documents(spark, edge_rows)
    for labels in ([], [(1, 1, 1)], [(1, 1, 1), (1, 0, 0), (2, None, 2), (None, 1, 1)], [(1, 1, 1), (2, 0, 0), (7, 1, 0), (10, 0, 1)]):
        got = op.score(docs, op.train(docs, labelled(spark, labels))).collect()
        assert len(got) == len(edge_rows)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    empty = documents(spark, [])
    assert op.score(empty, op.train(empty, labelled(spark, []))).collect() == []


@pytest.mark.parametrize("position", [0, 1, 5])
def test_a_text_over_the_budget_is_skipped_and_nothing_else(spark, corpus, position):
    """The sample, and what is learned from it, is as if the long text had no label."""
    from pyspark.sql import functions as F

    from threadlens.llm.labelled import sample

    usable = [i for i, *_ in corpus[1] if not held(i, 3, 1) and not held(i, 4, 2)]
    order = [r.i for r in spark.createDataFrame([(i,) for i in usable], "i bigint").orderBy(F.shiftrightunsigned(F.xxhash64("i"), 1)).collect()]
    long = order[position]
    budget = sum(len(t.split()) for i, t in corpus[0] if i != long) + 10
    rows = [(i, t if i != long else "word " * (budget + 1)) for i, t in corpus[0]]
    with_long, without = labelled(spark, corpus[1]), labelled(spark, [x for x in corpus[1] if x[0] != long])
    for label, train in (("quality", quality.train), ("toxic", toxicity.train)):
        docs = documents(spark, rows)
        taken = [{r.doc_id for r in sample(docs, x, label, F.lit(True), 5000, budget).collect()} for x in (with_long, without)]
        assert taken[0] == taken[1] == {i for i, _ in rows} - {long}
        fits = [train(docs, x, 5000, budget) for x in (with_long, without)]
        score = {"quality": quality.score, "toxic": toxicity.score}[label]
        some = documents(spark, corpus[0][:60])
        assert [r.score for r in score(some, fits[0]).orderBy("doc_id").collect()] == [r.score for r in score(some, fits[1]).orderBy("doc_id").collect()]


def test_both_labels_stay_within_any_budget():
    from threadlens.llm.labelled import within

    rows = [{"doc_id": i, "label": int(i == 3), "n": n} for i, n in enumerate([900, 40, 30, 500, 20, 30])]
    assert within(rows, 1000) == {1, 2, 3, 4, 5}  # 0 does not fit beside the only text of label 1
    assert within(rows, 100) == {3, 4} and within(rows, 0) == {3, 4}  # the shortest of each label, whatever the budget
    assert within(rows, 10_000) == set(range(6)) and within([], 5) == set()
