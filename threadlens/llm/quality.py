"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words.  Every passage is described
by the learned embeddings of its words and of their ends (hashed, averaged) and
by surface features, and encoded by a learned layer; a gated attention network
(tanh times sigmoid) gives each passage a weight; the weighted sum of the
encoded passages is scored by a logistic unit.  All layers are learned together
from document labels alone, on every passage of the fitting documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_hash_mod, small_batches
from .labelled import sample

#: Labelled rows used for fitting, and words in all of them, at most; a row is used with its whole text or not at all.
TRAIN_ROWS = 5_000
TRAIN_WORDS = 6_400_000
#: Words in a passage.
PASSAGE = 128
#: Embeddings of hashed words and ends of words; the last one stands for a passage without words.
BUCKETS, EMBEDDING, END = 2048, 16, 3
HIDDEN, GATE, RATE, DECAY, SEED = 24, 12, 0.02, 1e-4, 7
#: Passes over the fitting documents, steps at least, and passages in a step, about.
EPOCHS, LEAST_STEPS, STEP_PASSAGES = 20, 300, 256
#: Passages whose words are spread out at a time, which bounds memory.
PIECE = 1024


def _classes() -> np.ndarray:
    """256 x 11: which class each byte belongs to."""
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ",.", "!?", "|", "#$%&*@^~", "<>=_{}[]\\/+", ";:'\"()-`", " "]
    out = np.zeros((256, len(kinds) + 1))
    for k, chars in enumerate(kinds):
        out[np.frombuffer(chars.encode(), np.uint8), k] = 1
    out[128:, -1] = 1
    return out


_CLASSES = _classes()
FEATURES = 11 + 9


class Bag(NamedTuple):
    """The passages of texts, in order: surface features, and ``counts`` marks (buckets of words and ends) of each."""

    x: np.ndarray
    marks: np.ndarray
    counts: np.ndarray


def passages(text: str) -> Bag:
    """Every passage of a whole text; no words give one passage of zeros with the last bucket as its mark."""
    ws = text.encode("utf-8", "replace").split()
    if not ws:
        return Bag(np.zeros((1, FEATURES)), np.array([BUCKETS], np.uint16), np.ones(1, np.int64))
    counts, rest = [], []
    for at in range(0, len(ws), PASSAGE):
        part = ws[at : at + PASSAGE]
        n = len(part)
        counts.append(np.bincount(np.frombuffer(b" ".join(part), np.uint8), minlength=256))
        lengths = list(map(len, part))
        pairs = max(1, n - 1)
        rest.append((
            np.log1p(n), sum(lengths) / n, np.log1p(max(lengths)), len(set(part)) / n,
            sum(map(eq, part, part[1:])) / pairs, len(set(zip(part, part[1:]))) / pairs,
            sum(x < 3 for x in lengths) / n, sum(map(bytes.isupper, part)) / n, sum(map(bytes.isalpha, part)) / n,
        ))
    counts = np.array(counts, float)
    total = counts.sum(1, keepdims=True)
    low = b" ".join(ws).lower().split()
    marks = np.empty((len(ws), 2), np.uint16)
    marks[:, 0] = np.fromiter(map(crc32, low), np.uint32, len(low)) % BUCKETS
    marks[:, 1] = np.fromiter((crc32(w[-END:], 1) for w in low), np.uint32, len(low)) % BUCKETS
    words = np.minimum(PASSAGE, len(ws) - PASSAGE * np.arange(len(rest)))
    return Bag(np.hstack([counts @ _CLASSES / total, np.array(rest, float)]), marks.reshape(-1), 2 * words)


def joined(bags: list[Bag]) -> tuple[Bag, np.ndarray]:
    """The bags as one, and where each begins."""
    starts = np.concatenate([[0], np.cumsum([len(b.x) for b in bags])[:-1]]).astype(int)
    return Bag(*(np.concatenate(part) for part in zip(*bags))), starts


def _pieces(bag: Bag) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(passages, their marks, where each passage's marks begin), some passages at a time."""
    ends = np.cumsum(bag.counts)
    for at in range(0, len(ends), PIECE):
        rows = slice(at, min(at + PIECE, len(ends)))
        first = ends[at] - bag.counts[at]
        yield rows, bag.marks[first : ends[rows.stop - 1]], ends[rows] - bag.counts[rows] - first


def embedded(bag: Bag, table: np.ndarray) -> np.ndarray:
    """The mean embedding of each passage's marks."""
    out = np.empty((len(bag.x), table.shape[1]))
    for rows, marks, begins in _pieces(bag):
        out[rows] = np.add.reduceat(table[marks], begins) / bag.counts[rows, None]
    return out


def _embedding_gradient(bag: Bag, buckets: int, g: np.ndarray) -> np.ndarray:
    out = np.zeros((buckets, g.shape[1]))
    for rows, marks, _ in _pieces(bag):
        n = rows.stop - rows.start
        own = np.repeat(np.arange(n), bag.counts[rows])
        seen = np.bincount(own * buckets + marks, minlength=n * buckets).reshape(n, buckets)
        out += (seen / bag.counts[rows, None]).T @ g[rows]
    return out


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    layers: dict[str, np.ndarray] | None
    prior: float = 0.5

    def score_bags(self, bag: Bag, starts: np.ndarray) -> np.ndarray:
        """Scores of documents whose passages begin at ``starts``."""
        if self.layers is None:
            return np.full(len(starts), self.prior)
        return _forward(self.layers, bag._replace(x=(bag.x - self.mean) / self.std), starts)["p"]


def _forward(p: dict[str, np.ndarray], bag: Bag, starts: np.ndarray) -> dict:
    of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(bag.x)]))
    x = np.hstack([bag.x, embedded(bag, p["E"])])
    h = np.tanh(x @ p["W"] + p["c"])
    a, b = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -40, 40)))
    e = (a * b) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[of])
    att = e / np.add.reduceat(e, starts)[of]
    z = np.add.reduceat(att[:, None] * h, starts)
    out = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["d"], -40, 40)))
    return {"of": of, "x": x, "h": h, "a": a, "b": b, "att": att, "z": z, "p": out}


def _backward(p: dict, bag: Bag, starts: np.ndarray, f: dict, y: np.ndarray, weight: np.ndarray) -> dict:
    g = weight * (f["p"] - y)
    dz = g[:, None] * p["o"]
    through = (f["h"] * dz[f["of"]]).sum(1)
    de = f["att"] * (through - np.add.reduceat(f["att"] * through, starts)[f["of"]])
    dab = de[:, None] * p["w"]
    da, db = dab * f["b"] * (1 - f["a"] ** 2), dab * f["a"] * f["b"] * (1 - f["b"])
    dh = f["att"][:, None] * dz[f["of"]] + da @ p["V"].T + db @ p["U"].T
    pre = dh * (1 - f["h"] ** 2)
    words = _embedding_gradient(bag, len(p["E"]), pre @ p["W"][bag.x.shape[1] :].T)
    return {"E": words, "W": f["x"].T @ pre, "c": pre.sum(0), "V": f["h"].T @ da, "U": f["h"].T @ db, "w": (f["a"] * f["b"]).T @ de, "o": f["z"].T @ g, "d": g.sum()}


def _steps(sizes: np.ndarray, rng: np.random.Generator, epochs: int) -> Iterator[np.ndarray]:
    """Shuffled documents, STEP_PASSAGES passages at a time, about; every pass uses every document."""
    done, passes = 0, 0
    while passes < epochs or done < LEAST_STEPS:
        order = rng.permutation(len(sizes))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes[order]) // STEP_PASSAGES)) + 1
        for part in np.split(order, cuts):
            yield part
            done += 1
        passes += 1


def fit(bags: list[Bag], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Fits by Adam on batches.  Without both labels the score is the share of label 1 (0.5 without rows)."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None, float(y.mean()) if len(y) else 0.5)
    x = np.concatenate([b.x for b in bags])
    mean, std = x.mean(0), x.std(0) + 1e-3
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: rng.standard_normal(shape) / shape[0] ** 0.5
    p = {"E": np.zeros((BUCKETS + 1, EMBEDDING)), "W": draw(FEATURES + EMBEDDING, HIDDEN), "c": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "o": draw(HIDDEN), "d": np.zeros(())}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    bags = [b._replace(x=(b.x - mean) / std) for b in bags]
    for t, part in enumerate(_steps(np.array([len(b.x) for b in bags]), rng, epochs), 1):
        bag, starts = joined([bags[k] for k in part])
        g = _backward(p, bag, starts, _forward(p, bag, starts), y[part], np.full(len(part), 1 / len(part)))
        for k in p:
            g[k] = g[k] + DECAY * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, std, p)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS, epochs: int = EPOCHS) -> Model:
    """Fits on at most ``rows`` labelled documents of at most ``words`` words in all, without those held out.

    The executors describe the passages; the driver gets two bytes for each
    word and end, and FEATURES numbers a passage.
    """
    picked = sample(docs, labels, "quality", id_hash_mod("doc_id", 3) != 1, rows, words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [passages(t) for t in batch["text"]]
            kinds = zip(("x", "marks", "counts"), ("<f4", "<u2", "<i8"))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"]} | {k: [getattr(b, k).astype(f).tobytes() for b in bags] for k, f in kinds})

    kind = picked.schema["doc_id"].dataType.simpleString()
    got = small_batches(picked).mapInPandas(run, f"doc_id {kind}, label int, x binary, marks binary, counts binary").toPandas().sort_values("doc_id")
    read = zip(got["x"], got["marks"], got["counts"])
    bags = [Bag(np.frombuffer(x, "<f4").reshape(-1, FEATURES).astype(float), np.frombuffer(m, "<u2"), np.frombuffer(c, "<i8")) for x, m, c in read]
    return fit(bags, got["label"].to_numpy(), epochs)


def _score_texts(texts: list, model: Model) -> np.ndarray:
    scores, at = np.empty(len(texts)), 0
    while at < len(texts):  # a bounded number of passages at a time
        bags, rows, begin = [], 0, at
        while at < len(texts) and rows < 4 * PIECE:
            bags.append(passages(texts[at] or ""))
            rows, at = rows + len(bags[-1].x), at + 1
        scores[begin:at] = model.score_bags(*joined(bags))
    return scores


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of (doc_id, text), whole texts.

    Null or empty text is one passage of zeros and scores as such.  A null id
    is not held out.  Rows stay as they are, repeated ones too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "held_out": batch["held_out"], "score": _score_texts(batch["text"].tolist(), model)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(id_hash_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    out = small_batches(docs.select("doc_id", held, "text")).mapInPandas(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score() predicts as 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score_texts(batch.column("text").to_pylist(), model) >= threshold))

    return small_batches(docs).mapInArrow(run, docs.schema)
