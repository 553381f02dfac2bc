"""Parts of speech and lemmas for the normalisation of texts.

The tagger is an averaged structured perceptron: a tag sequence scores the sum
of what each word, its neighbours and each pair of tags say for it, and the best
sequence is found by the Viterbi recursion.  What a word says depends on the
word alone (its spelling, endings and shape), so that scores are computed once
for each distinct word of a batch and the recursion runs over all its texts
together.  Lemmas come from a trie of word endings, each with the change that
most words of that ending need, and a list of exceptions.

Both learn from a bounded labelled table, by default the one of ``english``, on
the driver, once; what they learned is sent to the tasks.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import DISCOURSE_STOPWORDS
from . import english
from .text import PUNCTUATION, stopwords

#: Parts of speech that tokens() keeps.
CONTENT = ("NOUN", "VERB", "ADJ", "ADV")
#: Parts of speech that have new words.
OPEN = (*CONTENT, "PROPN")
#: One word in so many trains by its endings and neighbours only, as if it was new.
AS_NEW = 3
#: Words whose scores or lemmas are remembered at a time, and words of texts that are tagged at a time, about: what a task holds.
REMEMBERED, WORDS_AT_ONCE = 20_000, 20_000
#: Sentences drawn by rule, beside the labelled examples, which count several times; rounds of training.
DRAWN, TIMES, ROUNDS = 900, 4, 6

Sentence = list[tuple[str, str]]


def own_features(word: str) -> list[str]:
    low = word.lower()
    out = [f"w={low}", *(f"s{k}={low[-k:]}" for k in range(1, 5) if len(low) > k), f"p={low[:2]}"]
    if word[:1].isupper():
        out.append("caps" if word.isupper() and len(word) > 1 else "cap")
    if any(c.isdigit() for c in word):
        out.append("number" if word.isdigit() else "digit")
    if "-" in word or "_" in word:
        out.append("joined")
    return out


def side_features(word: str, side: str) -> list[str]:
    low = word.lower()
    return [f"{side}w={low}", f"{side}s={low[-3:]}", f"{side}c={word[:1].isupper()}"]


@dataclass
class Tagger:
    """tags; weights: feature -> what it says for each tag; moves: (tags + 1, tags), the last row for the first word.

    A word takes a tag of a closed class only if it was ``seen`` with it (or has
    a digit, for numbers), and of names only if it was, or begins with a capital.
    """

    tags: tuple[str, ...]
    weights: dict[str, np.ndarray]
    moves: np.ndarray
    seen: dict[str, frozenset[str]] = field(default_factory=dict)
    _known: dict = field(default_factory=dict, repr=False)

    def says(self, features: Iterable[str]) -> np.ndarray:
        out = np.zeros(len(self.tags))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                out += w
        return out

    def _of(self, word: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a word says for itself, for the word behind it and for the one before it; None stands beyond the ends."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            own = self.says(own_features(word)) if word is not None else np.zeros(len(self.tags))
            if word is not None and self.seen:
                may = {*CONTENT, *self.seen.get(word.lower(), ()), *(("PROPN",) if word[:1].isupper() else ()), *(("NUM",) if any(c.isdigit() for c in word) else ())}
                own = own - np.array([0.0 if t in may else 1e6 for t in self.tags])
            found = self._known[word] = (own, self.says(side_features(word or "", "l")), self.says(side_features(word or "", "r")))
        return found

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, tags): what words and neighbours say."""
        of = [self._of(w) for w in words]
        out = np.array([x[0] for x in of])
        out += [self._of(None)[1], *(x[1] for x in of[:-1])]
        out += [*(x[2] for x in of[1:]), self._of(None)[2]]
        return out

    def best(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag sequence of each text, all texts at once, position by position; of equals the earlier tags."""
        lengths = np.array([len(s) for s in scores])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        if not lengths.size or not lengths[0]:
            return [np.zeros(0, int) for _ in scores]
        flat, starts = np.concatenate([scores[i].reshape(-1, len(self.tags)) for i in order]), np.cumsum(lengths) - lengths
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        back, now = np.zeros(flat.shape, np.int16), np.zeros((len(scores), len(self.tags)))
        for t, n in enumerate(active):
            at = starts[:n] + t
            if t == 0:
                now[:n] = flat[at] + self.moves[-1]
                continue
            step = now[:n, :, None] + self.moves[None, :-1]
            back[at] = step.argmax(1)
            now[:n] = step.max(1) + flat[at]
        out: list = [None] * len(scores)
        last = now.argmax(1)
        for row, i in enumerate(order):
            tags = np.zeros(lengths[row], int)
            k = last[row]
            for t in range(lengths[row] - 1, -1, -1):
                tags[t] = k
                k = back[starts[row] + t, k]
            out[i] = tags
        return out

    def tag(self, texts: list[list[str]]) -> list[list[str]]:
        found = self.best([self.scores(words) if words else np.zeros((0, len(self.tags))) for words in texts])
        return [[self.tags[k] for k in tags] for tags in found]


def train(labelled: list[Sentence], rounds: int = ROUNDS) -> Tagger:
    """Learns from labelled sentences in their order; the weights are the mean over all steps."""
    rng = random.Random(1)
    tags = tuple(sorted({t for s in labelled for _, t in s}))
    at = {t: k for k, t in enumerate(tags)}
    tagger = Tagger(tags, {}, np.zeros((len(tags) + 1, len(tags))))
    sums: dict[str, np.ndarray] = {}
    move_sums = np.zeros_like(tagger.moves)
    data = []
    for s in labelled:
        words = [w for w, _ in s]
        new = [t in OPEN and rng.randrange(AS_NEW) == 0 for _, t in s]
        sides = [[*own_features(w), *side_features(words[i - 1] if i else "", "l"), *side_features(words[i + 1] if i + 1 < len(words) else "", "r")] for i, w in enumerate(words)]
        for i in np.flatnonzero(new):
            for k, mark in ((i, "w="), (i + 1, "lw="), (i - 1, "rw=")):
                if 0 <= k < len(words):
                    sides[k] = [f for f in sides[k] if not f.startswith(mark)]
        data.append((sides, np.array([at[t] for _, t in s])))
    step = 1
    for _ in range(rounds):
        for features, want in data:
            got = tagger.best([np.array([tagger.says(f) for f in features])])[0]
            if not np.array_equal(got, want):
                for i, f in enumerate(features):
                    if got[i] != want[i]:
                        for x in f:
                            if x not in tagger.weights:
                                tagger.weights[x], sums[x] = np.zeros(len(tags)), np.zeros(len(tags))
                            for k, sign in ((want[i], 1.0), (got[i], -1.0)):
                                tagger.weights[x][k] += sign
                                sums[x][k] += sign * step
                for seq, sign in ((want, 1.0), (got, -1.0)):
                    for a, b in zip([len(tags), *seq[:-1]], seq):
                        tagger.moves[a, b] += sign
                        move_sums[a, b] += sign * step
            step += 1
    seen: dict[str, set[str]] = {}
    for word, tag in (x for s in labelled for x in s):
        seen.setdefault(word.lower(), set()).add(tag)
    return Tagger(tags, {x: w - sums[x] / step for x, w in tagger.weights.items()}, tagger.moves - move_sums / step, {w: frozenset(t) for w, t in seen.items()})


@dataclass
class Lemmas:
    """For each part of speech a trie of reversed endings; a node holds the change (letters to drop, letters to add) of its words."""

    exceptions: dict[tuple[str, str], str]
    tries: dict[str, dict]
    _known: dict = field(default_factory=dict, repr=False)

    def of(self, word: str, pos: str) -> str:
        """The lemma of a lower-case word: an exception, or the change of the longest known ending that leaves a stem."""
        key = (word, pos)
        if key in self.exceptions:
            return self.exceptions[key]
        found = self._known.get(key)
        if found is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            node, change = self.tries.get(pos, {}), (0, "")
            for c in reversed(word):
                node = node.get(c)
                if node is None:
                    break
                drop, add = node[""]
                if len(word) - drop + len(add) >= 2:
                    change = drop, add
            found = self._known[key] = word[: len(word) - change[0]] + change[1]
        return found


def change(form: str, lemma: str) -> tuple[int, str]:
    k = 0
    while k < min(len(form), len(lemma)) and form[k] == lemma[k]:
        k += 1
    return len(form) - k, lemma[k:]


def learn_lemmas(forms: list[tuple[str, str, str]], irregular: list[tuple[str, str, str]] = (), ending: int = 6) -> Lemmas:
    """Tries over the endings of the forms, up to so many letters; irregular forms, and those that their endings get wrong, are exceptions."""
    votes: dict[tuple[str, str], Counter] = {}
    for form, pos, lemma in sorted(set(forms)):
        for k in range(1, min(ending, len(form)) + 1):
            votes.setdefault((pos, form[-k:]), Counter())[change(form, lemma)] += 1
    out = Lemmas({(form, pos): lemma for form, pos, lemma in irregular}, {})
    for (pos, end), found in sorted(votes.items(), key=lambda x: len(x[0][1])):
        node = out.tries.setdefault(pos, {})
        for c in reversed(end):
            node = node.setdefault(c, {})
        node[""] = min(found, key=lambda c: (-found[c], c))
    for form, pos, lemma in sorted(set(forms)):
        if out.of(form, pos) != lemma:
            out.exceptions.setdefault((form, pos), lemma)
    out._known.clear()
    return out


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    return train(english.examples() * TIMES + english.sentences(DRAWN))


@lru_cache(maxsize=1)
def default_lemmas() -> Lemmas:
    return learn_lemmas(english.forms(), english.irregular_forms())


_DELETED = str.maketrans("", "", PUNCTUATION)


def content_tokens(texts: list[str | None], tagger: Tagger, lemmas: Lemmas, stop: frozenset[str]) -> list[list[str] | None]:
    """Lower-case lemmas of the nouns, verbs, adjectives and adverbs of each text.

    Numbers, words of punctuation only, single letters and stop words go, and so
    do verbs of discourse.  Null stays null.  Texts are worked on in portions, so
    that memory does not grow with a batch.
    """
    out: list[list[str] | None] = []
    for part in portions(texts):
        out += _content_tokens(part, tagger, lemmas, stop)
    return out


def portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, some at a time: about WORDS_AT_ONCE words of eight letters, or one longer text."""
    part, size = [], 0
    for t in texts:
        n = len(t or "") // 8 + 1
        if part and size + n > WORDS_AT_ONCE:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def _content_tokens(texts: list[str | None], tagger: Tagger, lemmas: Lemmas, stop: frozenset[str]) -> list[list[str] | None]:
    words = [(t or "").translate(_DELETED).split() for t in texts]
    out: list[list[str] | None] = []
    for text, own, tags in zip(texts, words, tagger.tag(words)):
        kept = []
        for word, pos in zip(own, tags):
            lemma = lemmas.of(word.lower(), pos)
            if lemma.isnumeric() or not lemma.strip("_-") or (pos == "VERB" and lemma in DISCOURSE_STOPWORDS):
                continue
            if pos in CONTENT and len(lemma) >= 2 and lemma not in stop:
                kept.append(lemma)
        out.append(None if text is None else kept)
    return out


def tagged_tokens(spark: SparkSession, text: Column, tagger: Tagger | None = None, lemmas: Lemmas | None = None, stop: frozenset[str] | None = None) -> Column:
    """content_tokens() of a column, in Arrow batches."""
    sent = spark.sparkContext.broadcast((tagger or default_tagger(), lemmas or default_lemmas(), stopwords() if stop is None else stop))

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(content_tokens(texts.tolist(), *sent.value), dtype=object)

    return tokens(text)
