"""Exact deduplication by deterministic block naming (DataFrame functions only).

Every text is cut into fixed-size blocks.  Equal blocks get one integer name:
distinct blocks are sorted by their key (a digest, see below) and numbered by
rank, so names are the same for every partitioning and every rerun.  Adjacent
names are then paired and the pairs named the same way, level after level, until
each document has a single name.  Two documents with the same number of blocks
carry the same name exactly if their texts are equal.

Block contents travel once, combined on the map side.  Every later step moves
a 32-byte digest of the block; while naming, the operator counts how many
distinct contents each digest stands for, so a digest is used only where it is
proven to stand for one content.  If one stands for two, the blocks themselves
are the keys instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import SPACE, cut, free_name, is_empty, matching, text_of

#: Code points in a block.
BLOCK = 8192
#: monotonically_increasing_id() holds the partition above this many bits and the row's place in it below.
PART_BITS = 33


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), SPACE, " ")


def _digest(block: Column) -> Column:
    return F.unhex(F.sha2(block, 256))


def _blocks(docs: DataFrame, block: int, digest) -> DataFrame:
    """One row for each block: uid, doc_id, pos, n, key, block; text_sha256 on the first.

    uid numbers input rows; an id may be null or repeated.  An empty text has
    one empty block.
    """
    cuts = F.regexp_extract_all(F.col("norm"), F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), normalised().alias("norm"))
    rows = rows.select("uid", "doc_id", F.sha2("norm", 256).alias("sha"), F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cuts).alias("cuts"))
    rows = rows.select("uid", "doc_id", "sha", F.size("cuts").alias("n"), F.posexplode("cuts").alias("pos", "block"))
    return rows.select("uid", "doc_id", "n", "pos", F.when(F.col("pos") == 0, F.col("sha")).alias("text_sha256"), "block", digest(F.col("block")).alias("key"))


def _numbered(distinct: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys with name: their rank in sorted order (0, 1, 2, ...), however the input is partitioned.

    Keys are dealt out in sorted ranges and counted within each; a range starts
    from the number of keys in the ranges before it (one row a partition).
    """
    placed = cut(distinct.orderBy(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", PART_BITS)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    within = F.col("at").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    return numbered.withColumn("name", F.col("start") + within).drop("part", "start", "at")


def _named(docs: DataFrame, block: int, digest) -> DataFrame:
    """Level zero: uid, doc_id, n, pos, text_sha256, name."""
    rows = _blocks(docs, block, digest)
    contents = rows.select("key", "block").groupBy("key", "block").agg(F.count(F.lit(1)).alias("seen"))
    names = _numbered(contents.groupBy("key").agg(F.count(F.lit(1)).alias("contents")), "key")
    if is_empty(names.where("contents > 1")):
        keyed = rows.drop("block")
    else:
        keyed = rows.drop("key").withColumnRenamed("block", "key")
        names = _numbered(keyed.select("key").distinct(), "key")
    return cut(keyed.join(names.select("key", "name"), "key").drop("key"))


def identities(docs: DataFrame, block: int = BLOCK, digest=_digest) -> DataFrame:
    """(uid, doc_id, text_sha256, n, name): (n, name) is the collision-free identity of a text.

    ``docs`` needs doc_id and text; other columns are ignored.  Null text is
    empty text.  Null or repeated ids are kept: each input row is its own row.
    """
    level = _named(docs, block, digest)
    done = [level.where("n = 1").select("uid", "doc_id", "text_sha256", F.col("n").alias("blocks"), "name")]
    heads = level.where("n > 1 AND pos = 0").select("uid", "doc_id", "text_sha256", F.col("n").alias("blocks"))
    level = level.where("n > 1").select("uid", "n", "pos", "name")
    ends = []
    while not is_empty(level):
        pairs = level.groupBy("uid", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            F.shiftright(F.max("n") + 1, 1).alias("n"),
        )
        # Texts of unlike block counts finish at unlike levels and never meet under one name.
        names = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        level = cut(pairs.join(names, ["a", "b"]).select("uid", "n", "pos", "name"))
        ends.append(level.where("n = 1").select("uid", "name"))
        level = level.where("n > 1")
    if ends:
        last = ends[0]
        for more in ends[1:]:
            last = last.unionByName(more)
        done.append(heads.join(last, "uid").select("uid", "doc_id", "text_sha256", "blocks", "name"))
        return done[0].unionByName(done[1])
    return done[0]


def dedup(docs: DataFrame, block: int = BLOCK, digest=_digest) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest doc_id stays; null ids come after all others.
    Among rows with equal text and equal id, only the first counted row is kept.
    Empty input gives an empty result.
    """
    rows = cut(identities(docs, block, digest))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("uid")))
    groups = cut(rows.groupBy("blocks", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")))
    return rows.join(groups, ["blocks", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that dedup() keeps, with all their columns."""
    sha = free_name(docs, "text_sha256")
    judged = cut(dedup(docs, block).select("doc_id", F.col("text_sha256").alias(sha), "kept"))
    kept = judged.where("kept").drop("kept")
    if is_empty(judged.groupBy("doc_id").count().where("count > 1")):  # an id tells its row, so no text is hashed again
        return docs.alias("d").join(kept.select("doc_id").alias("k").hint("merge"), matching("d", "k", "doc_id"), "left_semi")
    marked = docs.withColumn(sha, F.sha2(normalised(), 256)).alias("d")
    out = marked.join(kept.alias("k").hint("merge"), matching("d", "k", "doc_id", sha), "left_semi")
    # One (id, text) pair is kept once; rows can only repeat it if the input repeats it.
    if not is_empty(judged.groupBy("doc_id", sha).count().where("count > 1")):
        out = out.dropDuplicates(["doc_id", sha])
    return out.drop(sha)
