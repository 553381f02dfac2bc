"""Toxicity by a counterfactual-regularised linear classifier.

A document is the set of its words and their beginnings.  Each word's column is scaled by its
log-odds between the two labels in the sample, then a logistic regression with
an L1 penalty is fitted, so most words get no weight.  Where a labelled
sentence names an identity group, copies with the other terms of the same kind
are made, and the squared change of the score between the sentence and its
copies is penalised: a group's name alone cannot carry weight.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_hash_mod, small_batches
from .labelled import sample

#: Labelled rows used for fitting, and words in all of them, at most; a row is used with its whole text or not at all.
TRAIN_ROWS = 8_000
TRAIN_WORDS = 4_000_000
#: Words that occur in fewer sampled documents are not learned.
MIN_DOCS = 4
#: Lengths of the beginnings of words that count as features of their own.
STEMS = (4, 5)
#: Words whose log-odds between the labels are smaller are not learned.
MIN_ODDS = 0.5
#: Kinds of identity terms; a term is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "sikh", "catholic"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "turkish", "polish"),
    ("immigrants", "refugees", "foreigners", "locals", "citizens"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
)
#: Weight of the counterfactual penalty and of the L1 penalty.
COUNTERFACTUAL = 1.0
L1 = 2e-5
ROUNDS = 300

_WORDS = re.compile(r"[^\W\d_]+").findall
_SENTENCE = re.compile(r"[.!?\n]+")
_OTHERS = {t: [o for o in kind if o != t] for kind in IDENTITY_TERMS for t in kind}


def words(text: str) -> set[str]:
    return set(_WORDS(text.lower()))


def with_stems(found: Iterable[str]) -> set[str]:
    """The words and, for longer ones, their beginnings (marked by a hyphen), which inflected forms share."""
    found = set(found)
    return found.union(*({w[:k] + "-" for w in found if len(w) > k} for k in STEMS))


def swaps(text: str) -> list[tuple[str, str]]:
    """(sentence, sentence with another term of the same kind) for each identity term in it."""
    out = []
    if not _OTHERS.keys().isdisjoint(words(text)):
        for sentence in _SENTENCE.split(text.lower()):
            named = words(sentence) & _OTHERS.keys()
            for term in sorted(named):
                out += [(sentence, re.sub(rf"\b{term}\b", other, sentence)) for other in _OTHERS[term]]
    return out


def _change(before: set[str], after: set[str]) -> str:
    """Lost and gained features, each sorted and joined by spaces, with a tab between them."""
    a, b = with_stems(before), with_stems(after)
    return " ".join(sorted(a - b)) + "\t" + " ".join(sorted(b - a))


def changes(text: str) -> Counter[str]:
    """How many of ``swaps(text)`` make each change; the penalty depends on nothing else of them."""
    out: Counter[str] = Counter()
    if not _OTHERS.keys().isdisjoint(words(text)):
        for sentence in _SENTENCE.split(text.lower()):
            have = words(sentence)
            for term in have & _OTHERS.keys():
                rest, found = re.subn(rf"\b{term}\b", " ", sentence)
                left = words(rest)
                out.update(_change(have, left | {other} if found else have) for other in _OTHERS[term])
    return out


@dataclass
class Model:
    """score(text) = 1 / (1 + exp(-(bias + sum of the weights of the words present)))"""

    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        z = self.bias + sum(map(self.weights.get, sorted(self.weights.keys() & with_stems(words(text)))))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: Iterable[Iterable[str]], labels: np.ndarray, pairs: list[tuple[str, str]] | Counter[str], counterfactual: float = COUNTERFACTUAL, l1: float = L1, rounds: int = ROUNDS) -> Model:
    """Fits on word sets; ``pairs`` are (sentence, swapped sentence), or counts of their ``changes``.

    Without rows of both labels the model is the constant share of label 1
    (0.5 without any rows).
    """
    y = np.asarray(labels, float)
    if not len(y):
        return Model()
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    prior = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Model(prior)
    index: dict[str, int] = {}
    rows = [np.fromiter((index.setdefault(w, len(index)) for w in with_stems(ws)), np.int32) for ws in texts]
    own, flat = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows)
    in_one = np.bincount(flat, y[own], len(index))
    in_any = np.bincount(flat, minlength=len(index))
    odds = np.log((in_one + 0.5) / (y.sum() + 1)) - np.log((in_any - in_one + 0.5) / (len(y) - y.sum() + 1))
    # Words by text, so that nothing depends on the order of rows.
    vocab = sorted(w for w, k in index.items() if in_any[k] >= MIN_DOCS and abs(odds[k]) >= MIN_ODDS)
    column = {w: k for k, w in enumerate(vocab)}
    scale = np.abs(odds[[index[w] for w in vocab]]) if vocab else np.zeros(0)
    to_column = np.full(len(index), -1, np.int32)
    to_column[[index[w] for w in vocab]] = np.arange(len(vocab), dtype=np.int32)
    del index
    cols = to_column[flat]
    known = cols >= 0
    order = np.lexsort((cols[known], own[known]))
    x = (own[known][order], cols[known][order], scale[cols[known][order]], len(y))
    counts = pairs if isinstance(pairs, Counter) else Counter(_change(words(a), words(b)) for a, b in pairs)
    moved = []
    for k, change in enumerate(sorted(counts)):  # words gained minus words lost, a row for each distinct change
        for sign, side in zip((-1.0, 1.0), change.split("\t")):
            moved += [(k, column[f], sign * counts[change] ** 0.5 * scale[column[f]]) for f in side.split() if f in column]
    d = (np.array([c[0] for c in moved], int), np.array([c[1] for c in moved], int), np.array([c[2] for c in moved], float), len(counts))
    total = sum(counts.values())

    def times(m, w):
        return np.bincount(m[0], m[2] * w[m[1]], m[3]) if len(m[0]) else np.zeros(m[3])

    def back(m, g):
        return np.bincount(m[1], m[2] * g[m[0]], len(vocab)) if len(m[0]) else np.zeros(len(vocab))

    n, w, bias = len(y), np.zeros(len(vocab)), prior
    v, vb, t = w.copy(), bias, 1.0
    # Step from the largest eigenvalue of the Hessian's bound, by power iteration.
    u = np.ones(len(vocab)) / max(1, len(vocab)) ** 0.5
    top = 1.0
    for _ in range(30 if len(vocab) else 0):
        h = back(x, times(x, u)) / (4 * n) + (2 * counterfactual * back(d, times(d, u)) / total if total else 0)
        top = float(np.linalg.norm(h)) or 1.0
        u = h / top
    step = 1.0 / (1.1 * top + 0.25)
    for _ in range(rounds):
        g = _sigmoid(times(x, v) + vb) - y
        grad = back(x, g) / n + (2 * counterfactual * back(d, times(d, v)) / total if total else 0)
        new, new_b = v - step * grad, vb - step * g.mean()
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - bias)
        w, bias, t = new, new_b, t2
    return Model(float(bias), {vocab[k]: float(w[k] * scale[k]) for k in np.flatnonzero(w)})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, words_in_all: int = TRAIN_WORDS, **options) -> Model:
    """Fits on at most ``rows`` labelled documents of at most ``words_in_all`` words, without those held out.

    The driver gets the distinct words of each and, once for each batch, the
    counts of the changes that its swaps make.
    """
    picked = sample(docs, labels, "toxic", id_hash_mod("doc_id", 4) != 2, rows, words_in_all)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for t in batch["text"]:
                counts.update(changes(t))
            # The changes of the whole batch go with its first row.
            told = ["\n".join(f"{c}\t{n}" for c, n in counts.items())] + [""] * (len(batch) - 1)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "words": [" ".join(sorted(words(t))) for t in batch["text"]], "changes": told[: len(batch)]})

    kind = picked.schema["doc_id"].dataType.simpleString()
    got = small_batches(picked).mapInPandas(run, f"doc_id {kind}, label int, words string, changes string").toPandas().sort_values(["doc_id", "words"])
    counts: Counter[str] = Counter()
    for line in (line for told in got["changes"] if told for line in told.split("\n")):
        change, n = line.rsplit("\t", 1)
        counts[change] += int(n)
    return fit((w.split() for w in got["words"]), got["label"].to_numpy(), counts, **options)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of (doc_id, text), whole texts.

    Null or empty text scores the model's base rate.  A null id is not held
    out.  Rows stay as they are, repeated ones too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "held_out": batch["held_out"], "score": [model.score(t or "") for t in batch["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(id_hash_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    out = small_batches(docs.select("doc_id", held, "text")).mapInPandas(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
