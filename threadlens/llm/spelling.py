"""Spelling variants: words one edit apart, found by merging light subtrees of tries.

Words (JVM): runs of letters, lower-cased, counted over all documents.

Shards: two words that differ by one edit share the first half or the second
half of the shorter one's letters.  A word is therefore filed under both halves,
for its own length and as the longer of two.  A shard that is still large is
split the same way: the edit lies in one half of the letters that its words
don't share yet, so they share the other half.  A window of one letter leaves
no more words than two letters have values, so every shard ends up bounded
whatever the words are, and no pair is lost.

Tries: the sorted words of a shard are a compressed trie.  At each branching
node the largest child continues the heavy path.  All other children are light:
their subtrees are merged into the node's errata trie with their first letter
replaced (terminals that coincide there differ by one replacement), held
against the heavy subtree with that letter replaced by the heavy one, skipped,
or with the heavy letter put before it.  A word is in a light subtree at most
log2(words) times, so the work is small-to-large.  An errata trie is kept as
the table of what remains of its terminals below the node.

A pair is found at the node where its words part, which lies in one window only,
so counts of near words add up over shards, and only counts and best partners
leave a task.
"""

from __future__ import annotations

import logging
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, is_empty, small_side, text_of

log = logging.getLogger(__name__)

#: Maximal runs of letters, once A-Z is lower-cased.
RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT, LEAST_RATIO = 5, 3, 2
#: One run in so many, by hash, loses a letter: planted misspellings.
PLANTED = 97
#: Words in a shard, at most; above the number of words that share all but two letters.
SHARD_WORDS = 20_000
#: After any string that begins with what stands before it.
LAST = "\U0010ffff"


def common(a: str, b: str, start: int = 0) -> int:
    """Length of the common beginning of two strings that share the first ``start`` letters."""
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


class Near:
    """Near words counted, and the best of them (largest count, then smallest word), for each word of a shard."""

    def __init__(self):
        self.of: dict[str, list] = {}

    def add(self, word: str, other: str, count: int, times: int = 1) -> None:
        have = self.of.get(word)
        if have is None:
            self.of[word] = [times, count, other]
            return
        have[0] += times
        if count > have[1] or (count == have[1] and other < have[2]):
            have[1], have[2] = count, other


def merge(words: list[str], counts: dict[str, int], length: int, head: int = 0, tail: int = 0) -> Near:
    """Near words among sorted distinct ``words`` that share ``head`` first and ``tail`` last letters.

    The words have ``length`` letters or one more; pairs of the longer ones are
    left to their own shard.  With a shared tail only pairs that part before it
    count: those of the other shards part later.
    """
    near, limit = Near(), length - tail if tail else length + 1
    todo = [(0, len(words))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        at = common(words[lo], words[hi - 1], head)
        if at >= limit:
            continue
        children, begin = [], lo
        while begin < hi:
            end = begin + 1 if len(words[begin]) == at else bisect_left(words, words[begin][: at + 1] + LAST, begin + 1, hi)
            children.append((begin, end))
            begin = end
        todo += children
        heavy = max(children, key=lambda c: c[1] - c[0])
        stem = words[lo][:at]
        letter = words[heavy[0]][at : at + 1]  # none where the heavy child is the word that ends here
        errata: dict[str, list[str]] = {}
        for child in children:
            if child is heavy:
                continue
            for i in range(*child):
                word = words[i]
                rest = word[at + 1 :]
                if len(word) > at:
                    if len(word) == length:
                        errata.setdefault(rest, []).append(word)  # first letter replaced, among light subtrees
                        if letter:
                            pair(near, counts, word, stem + letter + rest)  # and by the heavy letter
                    elif rest[:1] != word[at]:
                        pair(near, counts, word, stem + rest)  # first letter skipped, in any subtree
                if letter and len(word) == length:
                    pair(near, counts, word, stem + letter + word[at:])  # heavy letter skipped
        for same in errata.values():
            if len(same) > 1:
                cluster(near, counts, same)
    return near


def pair(near: Near, counts: dict[str, int], word: str, other: str) -> None:
    n = counts.get(other)
    if n is not None:
        near.add(word, other, n)
        near.add(other, word, counts[word])


def cluster(near: Near, counts: dict[str, int], same: list[str]) -> None:
    """Coinciding terminals: each is near to all others."""
    first, second = sorted(same, key=lambda w: (-counts[w], w))[:2]
    for word in same:
        best = second if word == first else first
        near.add(word, best, counts[best], len(same) - 1)


def counted(docs: DataFrame, planted: int = PLANTED, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of at least so many letters and occurrences.

    A run whose hash (of id and run) ``planted`` divides loses the letter at
    hash % length; 0 leaves all as they are.  A null text holds no word; a null
    id hashes as an empty one.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_of(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    word = F.col("run")
    if planted:
        runs = runs.where(F.length("run") >= letters)  # a run only gets shorter
        hash_ = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (F.col("h") % F.length("run")).cast("int")
        runs = runs.withColumn("h", hash_)
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(F.col("h") % planted == 0, shorter).otherwise(word)
    return runs.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _filed(word: Column, length: Column, head: Column, tail: Column) -> Column:
    """The shard of a word among words of ``length`` letters and one more that share ``head`` first and ``tail`` last letters."""
    name = F.concat_ws("/", length.cast("string"), F.substring(word, F.lit(1), head), F.when(tail > 0, F.substring(word, F.length(word) - tail + 1, tail)).otherwise(F.lit("")))
    return F.struct(name.alias("shard"), length.alias("length"), head.alias("head"), tail.alias("tail"))


def _halves(word: Column, length: Column, head: Column, tail: Column) -> list[Column]:
    """Both shards of a word once the window between head and tail is halved."""
    half = (head + F.floor((length - head - tail) / 2)).cast("int")
    return [_filed(word, length, half, tail), _filed(word, length, head, length - half)]


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, letters: int = LEAST_LETTERS) -> DataFrame:
    """word, n_near, best, best_n for each word that has one exactly one edit away.  ``words``: word (distinct), n."""
    size, none = F.length("word").cast("int"), F.lit(0)
    own = _halves(F.col("word"), size, none, none)
    longer = _halves(F.col("word"), size - 1, none, none)
    filed = words.select("word", "n", F.explode(F.when(size > letters, F.array(*own, *longer)).otherwise(F.array(*own))).alias("s")).select("word", "n", "s.*")
    parts = []
    while True:
        sizes = cut(filed.groupBy("shard").agg(F.count(F.lit(1)).alias("words")).where("words > 1"))
        large = sizes.where((F.col("words") > shard_words)).select("shard")
        fit = filed.join(sizes.where(F.col("words") <= shard_words).select("shard"), "shard", "left_semi")
        if is_empty(large):
            parts.append(fit)
            break
        narrow = F.col("length") - F.col("head") - F.col("tail") <= 1  # such shards are bounded by the alphabet
        wide = cut(filed.join(small_side(large), "shard", "left_semi"))
        parts += [fit, wide.where(narrow)]
        wide = wide.where(~narrow)
        if is_empty(wide):
            break
        each = F.explode(F.array(*_halves(F.col("word"), F.col("length"), F.col("head"), F.col("tail")))).alias("s")
        filed = wide.select("word", "n", each).select("word", "n", "s.*")
    columns = ["shard", "word", "n", "length", "head", "tail"]
    out = parts[0].select(columns)
    for more in parts[1:]:
        out = out.unionByName(more.select(columns))
    out = out.repartition("shard").sortWithinPartitions("shard", "word")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in zip(*(batch[c].tolist() for c in columns)))
        found: list[tuple] = []
        for _, shard in groupby(rows, key=lambda r: r[0]):
            shard = list(shard)
            _, _, _, length, head, tail = shard[0]
            near = merge([r[1] for r in shard], {r[1]: r[2] for r in shard}, length, head, tail)
            found += [(w, *x) for w, x in near.of.items()]
            if len(found) > 10_000:
                yield pd.DataFrame(found, columns=["word", "n_near", "best_n", "best"])
                found = []
        yield pd.DataFrame(found, columns=["word", "n_near", "best_n", "best"])

    part = out.mapInPandas(run, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("c"), F.col("best").alias("w"))).alias("b")
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.c")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms, by doubling the steps; counts at least double along a chain, so it is short and ends."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = step.drop("moved")
        if is_empty(step.where("moved")):
            return links


def variants(docs: DataFrame, planted: int = 0, ratio: int = LEAST_RATIO, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents.

    Near words are exactly one inserted, deleted or replaced letter apart.  A
    word's form is the near word with the largest n (the smallest in code-point
    order of equals) if that is at least ``ratio`` times its own, else null.
    The root is where the chain of forms ends, the word itself without one.
    Null and empty texts hold no words; repeated rows count again; without words
    the result is empty.
    """
    if ratio < 2:
        raise ValueError("counts have to double along a chain of forms")
    words = cut(counted(docs, planted, letters, least, id_col, text_col))
    near = near_words(words, shard_words, letters)
    # Words are few beside texts: one partition holds a fair share of both sides.
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best_n") >= ratio * F.col("n"), F.struct("best", "best_n")).alias("f"))
    found = cut(found.select("word", "n", "n_near", F.col("f.best").alias("form"), F.col("f.best_n").alias("form_n")))
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
