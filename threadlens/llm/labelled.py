"""A bounded sample of labelled documents for fitting."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import WORD, cut, smallest_by_hash, text_of

log = logging.getLogger(__name__)


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, words: int) -> DataFrame:
    """(doc_id, text, label): whole texts of at most ``rows`` labelled ids, chosen by hash of the id.

    ``usable`` says which ids may be learned from.  Labels other than 0 and 1,
    null ids and ids with two different labels are left out; of rows that share
    an id one text stays.  The shortest text of each label is always taken; the
    others are taken whole in order of their hash as long as all together hold
    at most ``words`` words.  One that would pass that is skipped, and the next
    ones are tried, so a very long text neither ends the sample nor takes a
    label out of it.  The id list has at most ``rows`` entries, which is what
    bounds the broadcasts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").drop("other")
    picked = smallest_by_hash(known, "doc_id", rows)
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    found = cut(found.select("doc_id", F.col("one.text").alias("text"), "label", F.xxhash64("doc_id").alias("h"), F.regexp_count("one.text", F.lit(WORD)).alias("n")))
    listed = found.select("doc_id", "label", "n").orderBy(F.shiftrightunsigned("h", 1), "doc_id").collect()  # at most ``rows`` short rows
    taken = within(listed, words)
    log.info("%s: %d of %d labelled texts, %d words", label, len(taken), len(listed), sum(r["n"] for r in listed if r["doc_id"] in taken))
    if len(taken) < len(listed):
        ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(taken)], "doc_id bigint")
        found = found.join(F.broadcast(ids), "doc_id", "left_semi")
    return found.select("doc_id", "text", "label")


def within(rows: list, words: int) -> set[int]:
    """Ids of the rows (doc_id, label, n) that are taken, in the order given, within a budget of words."""
    shortest: dict = {}
    for r in rows:
        if r["label"] not in shortest or r["n"] < shortest[r["label"]]["n"]:
            shortest[r["label"]] = r
    taken, have = {r["doc_id"] for r in shortest.values()}, sum(r["n"] for r in shortest.values())
    for r in rows:
        if r["doc_id"] not in taken and have + r["n"] <= words:
            taken.add(r["doc_id"])
            have += r["n"]
    return taken
