"""Hard-negative mining by exact inner products, pruned in an orthogonal PCA rotation.

Vectors are quantised to integers.  An orthogonal rotation (principal axes of a
bounded sample, leading ones first) keeps inner products, so the product of two
vectors is the product of their leading rotated components plus a remainder that
is at most the product of the norms of what is left.  Leading products are
accumulated a few components at a time; a pair goes as soon as its product so
far, plus the bound, plus a slack for rounding, is below what it has to reach.
What survives all components is verified by the integer product, and only that
product decides.

Rows lie in blocks of bounded size, in the order of their labels, and a label
that fills many blocks is dealt over them by hash.  Anchors come to the blocks
they need, in groups of bounded size: those of their own label to find the
positives, all that hold other labels to find the negatives.  No cell of blocks
and groups keeps more than a few rows for an anchor, so what is merged is short.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, small_side, smallest_by_hash

log = logging.getLogger(__name__)

#: Rows on which the rotation is learned, at most.  It decides how early pairs are discarded, never which are found.
SAMPLE_ROWS = 10_000
#: Components of the rows in a block, at least (as long as there are fewer blocks than cores keep busy) and at most; of the anchors in a group, about.
LEAST_CELLS, BLOCK_CELLS, GROUP_CELLS = 1 << 18, 1 << 22, 1 << 22
#: Steps in which the rotated components are accumulated.
STEPS = 4
#: Anchors worked on at a time in a task, and components of the pairs that are multiplied at a time.
STRIPE, VERIFY_CELLS = 128, 1 << 20
SCALE = 256
LONG = 1 << 63


def limit(dim: int) -> int:
    """The largest component whose inner products surely fit a long."""
    return min(2**31 - 1, math.isqrt((LONG - 1) // max(1, dim)))


def axes(sample: np.ndarray) -> np.ndarray:
    """Orthogonal columns, those with the largest mean square of the sample first; products need no centring."""
    x = sample.astype(float)
    x = x / max(1.0, np.abs(x).max(initial=0.0))
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


class Rotated:
    """Integer rows with their rotated components and, for each step, the norm of what the steps before leave."""

    def __init__(self, q: np.ndarray, turn: np.ndarray, ends: list[int]):
        self.q = q
        self.y = q.astype(float) @ turn
        squares = np.cumsum((self.y * self.y)[:, ::-1], axis=1)[:, ::-1]
        self.left = np.sqrt(np.column_stack([squares[:, e] if e < turn.shape[1] else np.zeros(len(q)) for e in ends]))
        self.norm = np.sqrt(squares[:, 0])


def step_ends(dim: int) -> list[int]:
    return sorted({max(1, math.ceil(dim * s / STEPS)) for s in range(1, STEPS + 1)})


def slack(dim: int) -> float:
    """By how much, over the product of the norms, sums of rotated doubles may be off: far more than rotation and summation can lose."""
    return 32.0 * dim * math.sqrt(dim) * np.finfo(float).eps


def pieces(pairs: int, dim: int) -> Iterator[slice]:
    size = max(1, VERIFY_CELLS // dim)
    for at in range(0, pairs, size):
        yield slice(at, at + size)


def survivors(a: Rotated, r: Rotated, ends: list[int], may: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) among those of ``may`` whose product may lie in [low, high] of the anchor."""
    room = slack(a.y.shape[1])
    so_far = np.zeros(may.shape)
    begin, pairs = 0, None
    for s, end in enumerate(ends):
        if pairs is None:
            so_far += a.y[:, begin:end] @ r.y[:, begin:end].T
            bound = np.outer(a.left[:, s], r.left[:, s]) + room * np.outer(a.norm, r.norm)
            may = may & (so_far + bound >= low[:, None]) & (so_far - bound <= high[:, None])
            if 4 * np.count_nonzero(may) <= may.size or end == ends[-1]:  # few are left: go on pair by pair
                pairs = np.nonzero(may)
                part = so_far[pairs]
        else:
            i, j = pairs
            for of in pieces(len(i), end - begin):
                part[of] += np.einsum("ij,ij->i", a.y[i[of], begin:end], r.y[j[of], begin:end])
            bound = a.left[i, s] * r.left[j, s] + room * a.norm[i] * r.norm[j]
            keep = (part + bound >= low[i]) & (part - bound <= high[i])
            pairs, part = (i[keep], j[keep]), part[keep]
        begin = end
    return pairs


def products(a: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs."""
    parts = [(a[i[of]] * r[j[of]]).sum(1) for of in pieces(len(i), a.shape[1])]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def stripes(rows: int) -> Iterator[slice]:
    """Ranges of rows, short ones first, as limits are loose until some rows were seen."""
    at, n = 0, 64
    while at < rows:
        yield slice(at, min(rows, at + n))
        at, n = at + n, min(4096, 4 * n)


def best_of(a: Rotated, own: np.ndarray, label: np.ndarray, r: Rotated, block: Block, ends: list[int], low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """(slot, row, score): for each slot, an interval [low, high] of an anchor, its k best rows of the block.

    low, high: (anchors, slots of an anchor).  ``same`` takes rows of the
    anchor's label without the anchor itself, else rows of other labels.
    """
    n, width = low.shape
    reach = low.astype(float)  # what a row has to reach to come in; rises as rows are found
    top = high.astype(float).max(1)
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    for of in stripes(len(block.ids)):
        may = (label[:, None] == block.labels[None, of]) & (own[:, None] != block.uids[None, of]) if same else label[:, None] != block.labels[None, of]
        part = Rotated.__new__(Rotated)
        part.q, part.y, part.left, part.norm = r.q[of], r.y[of], r.left[of], r.norm[of]
        i, j = survivors(a, part, ends, may, reach.min(1), top)
        if not len(i):
            continue
        score = products(a.q, part.q, i, j)
        j = j + of.start
        slots = [(i * width + w, j, score, (score >= low[i, w]) & (score <= high[i, w])) for w in range(width)]
        slot = np.concatenate([held[0], *(s[x] for s, _, _, x in slots)])
        row = np.concatenate([held[1], *(j[x] for _, j, _, x in slots)])
        score = np.concatenate([held[2], *(v[x] for _, _, v, x in slots)])
        order = np.lexsort((block.uids[row], block.ids[row], -score, slot))
        slot, row, score = slot[order], row[order], score[order]
        first = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - first < k
        held = slot[keep], row[keep], score[keep]
        full = np.flatnonzero(np.arange(len(slot)) - first == k - 1)
        reach.reshape(-1)[slot[full]] = np.maximum(reach.reshape(-1)[slot[full]], score[full])
    return held


class Block:
    """A block of rows as a task holds it."""

    def __init__(self, rows: pd.DataFrame, turn: np.ndarray, ends: list[int]):
        self.uids, self.ids, self.labels = (rows[c].to_numpy(np.int64) for c in ("uid", "id", "label"))
        self.vectors = Rotated(np.array(rows["q"].tolist(), np.int64).reshape(len(rows), len(turn)), turn, ends)


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, bounded to an int; no component of a usable row is changed by the bound."""
    most = float(2**31 - 1)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * float(scale), F.lit(most)), F.lit(-most))).cast("int"))


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN and infinite components."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: tuple[int, int] = (1, 2), most: tuple[int, int] = (19, 20),
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", least_cells: int = LEAST_CELLS, block_cells: int = BLOCK_CELLS, group_cells: int = GROUP_CELLS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its ``positives`` best other rows of its label;
    each has the ``negatives`` best rows of other labels whose score s lies in
    least * positive_score <= s <= most * positive_score (fractions).  Scores
    are inner products of quantised vectors, ties go to the smaller id.

    Rows with a null id, label or vector, or with a null or non-finite
    component, take no part, nor do vectors with a component whose products
    could leave a long (over 3.7e8 / 256 in 64 dimensions).  Vectors of unlike
    lengths are not compared.  Zero vectors, and those without components, take
    part with scores of zero.  Rows that repeat an id are rows of their own;
    where a positive is one of several rows with its id and score, any is it.
    An anchor without positives, and a positive without negatives, have no
    rows.  Empty input gives an empty result.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    x = F.col(vector_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    good = good.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("x")))
    good = good.select("id", "label", "anchor", F.when(F.size("x") == 0, F.array(F.lit(0))).otherwise(quantised(F.col("x"))).alias("q"))
    most_of = F.floor(F.sqrt(F.lit(float(LONG)) / F.size("q")))
    good = good.where(~F.exists("q", lambda c: (F.abs(c.cast("double")) >= most_of) | (F.abs(c.cast("double")) >= F.lit(2.0**31 - 1))))
    good = cut(good.withColumns({"dim": F.size("q"), "uid": F.monotonically_increasing_id()}))
    out = vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    for dim, rows, anchors in sorted(map(tuple, good.groupBy("dim").agg(F.count(F.lit(1)), F.count_if("anchor")).collect())):  # as a rule there is one length
        if anchors:
            out = out.unionByName(_mine(good.where(F.col("dim") == dim), dim, anchors, positives, negatives, least, most, least_cells, block_cells, group_cells, sample_rows))
    return out


def _mine(good: DataFrame, dim: int, anchors: int, positives: int, negatives: int, least: tuple[int, int], most: tuple[int, int], least_cells: int, block_cells: int, group_cells: int, sample_rows: int) -> DataFrame:
    """mine() among vectors of one length."""
    sample = smallest_by_hash(good.select("uid", "q"), "uid", sample_rows).toPandas()
    turn, ends = axes(np.array(sample["q"].tolist(), np.int64)), step_ends(dim)
    groups = math.ceil(anchors / max(1, group_cells // dim))
    # Rows stand in the order of their labels, at a place that their hash draws within the label; so many of them make a block.
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    labels = good.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = cut(labels.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))  # a row for each label
    total = labels.agg(F.max(F.col("base") + F.col("n"))).first()[0]
    wanted = math.ceil(total / (2 * good.sparkSession.sparkContext.defaultParallelism))
    block_rows = max(1, min(block_cells // dim, max(least_cells // dim, wanted)))
    blocks = math.ceil(total / block_rows)
    log.info("%d rows, %d anchors: %d blocks, %d groups", total, anchors, blocks, groups)
    block = lambda place: F.floor(place / F.lit(block_rows)).cast("int")
    placed = good.join(small_side(labels), "label")
    rows = placed.select(block(F.col("base") + F.pmod(F.xxhash64("uid"), F.col("n"))).alias("block"), "uid", "id", "label", "q")
    asked = placed.where("anchor").select("uid", "id", "label", "q", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("group"), block(F.col("base")).alias("first"), block(F.col("base") + F.col("n") - 1).alias("last"))
    asked = cut(asked)

    near = asked.withColumn("block", F.explode(F.sequence("first", "last"))).withColumns({"lows": F.array(F.lit(1 - LONG)), "highs": F.array(F.lit(LONG - 1))})
    found = _cells(rows, near, blocks, groups, turn, ends, positives, True)
    best = Window.partitionBy("uid").orderBy(F.col("score").desc(), "id", "other")
    found = cut(found.withColumn("slot", (F.row_number().over(best) - 1).cast("int")).where(F.col("slot") < positives))

    bounds = found.withColumns({"low": -_floored(-F.col("score"), *least), "high": _floored(F.col("score"), *most)})
    # A slot whose interval is empty asks for nothing, and an anchor of such slots only is not asked at all.
    open_ = bounds.where("low <= high")
    each = F.array_sort(F.collect_list(F.struct("slot", "low", "high")))
    wanted = open_.groupBy("uid").agg(each.alias("slots"))
    wanted = wanted.select("uid", F.transform("slots", lambda s: s["slot"]).alias("names"), F.transform("slots", lambda s: s["low"]).alias("lows"), F.transform("slots", lambda s: s["high"]).alias("highs"))
    asking = cut(asked.join(wanted, "uid"))
    # Blocks that lie wholly within the anchor's label hold no negatives.
    away = asking.withColumn("block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: (b <= F.col("first")) | (b >= F.col("last")))))
    other = _cells(rows, away, blocks, groups, turn, ends, negatives, False).withColumnRenamed("slot", "at")
    other = other.join(asking.select("uid", "names", F.col("id").alias("anchor_id")), "uid").withColumn("slot", F.get("names", F.col("at")))
    best = Window.partitionBy("uid", "slot").orderBy(F.col("score").desc(), "id", "other")
    other = other.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    out = other.select("uid", "slot", "anchor_id", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(found.select("uid", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["uid", "slot"]).drop("uid", "slot")


def _floored(s: Column, a: int, b: int) -> Column:
    """floor(s * a / b) of a long, exactly."""
    wide = s.cast("decimal(20,0)") * F.lit(a)
    return ((wide - F.pmod(wide, F.lit(b))) / F.lit(b)).cast("long")


def _cells(rows: DataFrame, asked: DataFrame, blocks: int, groups: int, turn: np.ndarray, ends: list[int], k: int, same: bool) -> DataFrame:
    """uid, slot, other, id, score: for each slot of an anchor, the k best rows of each block it was sent to.

    A cell is a block with a group of anchors.  Rows of a cell come first, then
    its anchors, a batch at a time.
    """
    none = F.array().cast("array<bigint>")
    own = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else rows.withColumn("group", F.lit(0))
    cell = (F.col("block") * F.lit(groups) + F.col("group")).cast("int").alias("cell")
    own = own.select(cell, F.lit(0).alias("kind"), "uid", "id", "label", "q", none.alias("lows"), none.alias("highs"))
    both = own.unionByName(asked.select(cell, F.lit(1).alias("kind"), "uid", "id", "label", "q", "lows", "highs"))
    both = both.repartitionById(blocks * groups, "cell").sortWithinPartitions("cell", "kind", "uid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, block = None, [], None
        for batch in batches:
            for (cell, kind), part in batch.groupby(["cell", "kind"], sort=True):
                if cell != at:
                    at, held, block = cell, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if block is None:
                    if not held:
                        continue
                    block, held = Block(pd.concat(held), turn, ends), []
                part = part.assign(width=part["lows"].map(len))
                for width, group in part.groupby("width"):  # anchors with equally many slots at a time
                    for begin in range(0, len(group), STRIPE):
                        some = group.iloc[begin : begin + STRIPE]
                        a = Rotated(np.array(some["q"].tolist(), np.int64).reshape(len(some), len(turn)), turn, ends)
                        low, high = (np.array(some[c].tolist(), np.int64).reshape(len(some), width) for c in ("lows", "highs"))
                        uids = some["uid"].to_numpy(np.int64)
                        slot, row, score = best_of(a, uids, some["label"].to_numpy(np.int64), block.vectors, block, ends, low, high, k, same)
                        yield pd.DataFrame({"uid": uids[slot // width], "slot": (slot % width).astype(np.int32), "other": block.uids[row], "id": block.ids[row], "score": score})

    return both.mapInPandas(run, "uid bigint, slot int, other bigint, id bigint, score bigint")
