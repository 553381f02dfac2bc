"""Approximate nearest neighbours by multi-index hashing.

Codes are the signs of the vectors after a learned rotation (principal axes,
then iterative quantisation, on a bounded sample).  A code is split into
substrings of about log2(rows) bits.  Each substring has an index of its own: a
table that files all rows under the substring's value, dealt to shards by the
value's leading bits (and, where one value holds many rows, by salt).

Two codes within R bits agree to within R/m bits in one of the m substrings;
with R = m a + r, to within a bits in one of the first r + 1 substrings or a - 1
in one of the others (pigeonhole).  A query goes to the shards whose leading
bits are that near, probes the buckets there, and verifies whole codes, so that
every code within R is retrieved, once.  Those are reranked by the cosine of
the original vectors in double precision, and the shards' best are merged.
Queries that find too few go round again with a wider radius.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, is_empty, small_side, smallest_by_hash

log = logging.getLogger(__name__)

#: Rows used to learn the rotation and the radius, at most.
SAMPLE_ROWS = 10_000
#: Queries of that sample on which recall is measured to choose the radius.
SAMPLE_QUERIES = 400
#: Rows in a shard of the index, about.
SHARD_ROWS = 16_384
#: Bits of a code, at least; bits of a substring, at least and at most.
CODE_BITS, LEAST_BITS, MOST_BITS = 64, 4, 24
#: Recall wanted on the sample.
TARGET_RECALL = 0.95
ROUNDS, SEED = 30, 11


@dataclass
class Codes:
    """Learned codes: bit k of x is on if (x/|x| - mean) . axes[:, k] > 0; substrings of ``width`` bits; radius as chosen on the sample."""

    mean: np.ndarray
    axes: np.ndarray
    width: int
    radius: int
    recall: float = 1.0

    @property
    def parts(self) -> int:
        return self.axes.shape[1] // self.width

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (unit(x) - self.mean) @ self.axes > 0

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """The values of the substrings of each row, first bit highest: (rows, parts) int32."""
        places = 1 << np.arange(self.width - 1, -1, -1, dtype=np.int32)
        return self.bits(x).reshape(len(x), self.parts, self.width) @ places

    def reach(self, radius: int) -> list[int]:
        """Bits by which each substring may differ (-1: not probed) so that all codes within ``radius`` are met."""
        a, rest = divmod(radius, self.parts)
        return [a if j <= rest else a - 1 for j in range(self.parts)]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over their largest component, so that no norm overflows, and the norms of the results."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x, np.sqrt((x * x).sum(1))


def cosines(rows: np.ndarray, lengths: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine in double precision of each scaled row to the query; equal rows get equal values."""
    query, length = scaled(query[None, :])
    return (rows * query).sum(1) / (lengths * length)


def width_for(rows: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(2, rows)))))


def learn(x: np.ndarray, k: int, recall: float = TARGET_RECALL, rows: int | None = None) -> Codes:
    """Learns the rotation on the rows of x, and the smallest radius that reaches ``recall`` for the k nearest in x.

    ``rows``: how many rows the index will hold (those of x if not told).
    """
    width = width_for(rows or len(x))
    rng = np.random.default_rng(SEED)
    u, dim = unit(x), x.shape[1]
    mean = u.mean(0)
    z = u - mean
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1]
    bits = max(2, round(CODE_BITS / width)) * width
    axes = axes[:, :bits]
    while axes.shape[1] < bits:  # more bits than dimensions take further directions
        axes = np.hstack([axes, np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : bits - axes.shape[1]]])
    z = z @ axes
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(ROUNDS):
        a, _, b = np.linalg.svd(np.sign(z @ turn).T @ z)
        turn = (a @ b).T
    codes = Codes(mean, axes @ turn, width, bits)
    own = codes.bits(x)
    pick = np.linspace(0, len(x) - 1, min(len(x), SAMPLE_QUERIES)).astype(int)
    near = []
    for q in pick:
        s = u @ u[q]
        s[q] = -np.inf
        top = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
        near.append((own[top] != own[q]).sum(1))
    spread = np.concatenate(near) if near else np.zeros(0)
    if len(spread):
        codes.radius = int(np.quantile(spread, recall, method="higher"))
        codes.recall = float((spread <= codes.radius).mean())
    return codes


def masks(width: int, within: int) -> np.ndarray:
    """All numbers of ``width`` bits of which at most ``within`` are set."""
    out = np.zeros(1, np.int32)
    for b in range(width):
        more = out | np.int32(1 << b)
        out = np.concatenate([out, more[np.bitwise_count(more) <= within]])
    return out


class Shard:
    """One shard of substring ``table``'s index, and the search in it."""

    def __init__(self, codes: Codes, table: int, uids: np.ndarray, ids: np.ndarray, subs: np.ndarray, x: np.ndarray):
        order = np.lexsort((uids, ids, subs[:, table]))
        self.codes, self.table = codes, table
        self.uids, self.ids, self.subs = uids[order], ids[order], subs[order]
        self.x, self.lengths = scaled(x[order])
        self.values, self.begins = np.unique(self.subs[:, table], return_index=True)
        self.ends = np.append(self.begins[1:], len(order))
        self.masks: dict[int, np.ndarray] = {}

    def _buckets(self, value: int, within: int) -> np.ndarray:
        """The filed values within so many bits: looked up one by one or, if there are fewer of them than probes, compared."""
        probes = sum(math.comb(self.codes.width, k) for k in range(within + 1))
        if probes >= len(self.values):
            return np.flatnonzero(np.bitwise_count(self.values ^ value) <= within)
        if within not in self.masks:
            self.masks[within] = masks(self.codes.width, within)
        wanted = self.masks[within] ^ value
        at = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
        return np.sort(at[self.values[at] == wanted])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` bits and that no earlier substring's table retrieves."""
        reach = self.codes.reach(radius)
        if reach[self.table] < 0:
            return np.zeros(0, np.int64)
        found = self._buckets(int(code[self.table]), reach[self.table])
        if not len(found):
            return found
        begins, n = self.begins[found], self.ends[found] - self.begins[found]
        rows = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())
        apart = np.bitwise_count(self.subs[rows] ^ code).astype(np.int64)
        mine = apart.sum(1) <= radius
        if self.table:
            mine &= (apart[:, : self.table] > np.array(reach[: self.table])).all(1)
        return rows[mine]

    def search(self, uid: int, code: np.ndarray, vector: np.ndarray, radius: int, k: int) -> Iterator[tuple[int, int, int, float]]:
        """(query row, row, id, cosine) of the query's k best in this shard, its own row left out; ties go to the smaller id."""
        rows = self.within(code, radius)
        rows = rows[self.uids[rows] != uid]
        if len(rows):
            score = cosines(self.x[rows], self.lengths[rows], vector)
            for r in np.lexsort((self.uids[rows], self.ids[rows], -score))[:k]:
                yield uid, int(self.uids[rows[r]]), int(self.ids[rows[r]]), float(score[r])


def usable(vector: Column) -> Column:
    """True for a vector with finite components only, not all zero."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda c: c != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS, recall: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row among all other rows.

    Vectors that are null, zero or hold a null or non-finite component take no
    part, nor do null ids.  Vectors of unlike lengths are not compared: each
    length has an index of its own.  Rows that repeat an id are rows of their
    own.  Ties in score go to the smaller id.  Where a query has no more than k
    other rows it finds them all.  Empty input gives an empty result.
    """
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = cut(good.where(F.col("id").isNotNull() & usable(F.col("x"))).withColumns({"dim": F.size("x"), "uid": F.monotonically_increasing_id()}))
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for dim, rows in sorted(map(tuple, good.groupBy("dim").count().collect())):  # as a rule there is one length
        out = out.unionByName(_search(good.where(F.col("dim") == dim), rows, k, shard_rows, sample_rows, recall))
    return out


def _search(good: DataFrame, rows: int, k: int, shard_rows: int, sample_rows: int, recall: float) -> DataFrame:
    """search() among ``rows`` vectors of one length."""
    sample = smallest_by_hash(good.select("uid", "id", "x"), "uid", sample_rows).toPandas()
    codes = learn(np.array(sample["x"].tolist(), float), k, recall, rows)
    log.info("%d rows: %d substrings of %d bits, radius %d, recall %.3f on the sample", rows, codes.parts, codes.width, codes.radius, codes.recall)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["subs"] = list(codes.substrings(np.array(batch["x"].tolist(), float))) if len(batch) else []
            yield batch

    coded = cut(good.select("uid", "id", "q", "x").mapInPandas(encode, "uid bigint, id bigint, q boolean, x array<double>, subs array<int>"))
    # Shards by the leading bits of a substring's value: as many as leave one about shard_rows, more for prefixes that hold more.
    lead = min(codes.width, max(0, math.ceil(math.log2(rows / shard_rows)))) if rows > shard_rows else 0
    each = F.posexplode("subs").alias("part", "value")
    prefix = F.shiftright("value", codes.width - lead).alias("prefix")
    filed = coded.select("uid", "id", "x", "subs", each).select("uid", "id", "x", "subs", "part", prefix)
    sizes = filed.groupBy("part", "prefix").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("salts"))
    # One row for about shard_rows rows of a table.
    before = Window.orderBy("part", "prefix").rowsBetween(Window.unboundedPreceding, -1)
    shards = cut(sizes.withColumn("base", F.coalesce(F.sum("salts").over(before), F.lit(0)).cast("int")))
    total = int(shards.agg(F.sum("salts")).first()[0])
    own = filed.join(small_side(shards), ["part", "prefix"])
    own = own.select((F.col("base") + F.pmod(F.xxhash64("uid"), F.col("salts"))).cast("int").alias("shard"), F.lit(0).alias("kind"), "part", "uid", "id", "x", "subs")
    asked = coded.where("q").select("uid", "id", "x", "subs")
    parts, found = codes.parts, []
    radius, last = codes.radius, parts * codes.width
    while True:
        got = cut(_round(own, asked, shards, codes, lead, radius, total, k))
        if radius < last:
            # Whoever found fewer than k, though there are as many, looks further.
            n = got.groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
            short = cut(asked.join(n, "uid", "left").where(F.coalesce("n", F.lit(0)) < min(k, rows - 1)).drop("n"))
            found.append(got.join(short.select("uid"), "uid", "left_anti"))
            if is_empty(short):
                break
            asked, radius = short, min(last, radius + 2 * parts) if len(found) == 1 else last
        else:
            found.append(got)
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.join(coded.where("q").select("uid", F.col("id").alias("query_id")), "uid").select("query_id", "rank", "vec_id", "score")


def _round(own: DataFrame, asked: DataFrame, shards: DataFrame, codes: Codes, lead: int, radius: int, total: int, k: int) -> DataFrame:
    """uid, rank, vec_id, score: the k best of each query row within the radius."""
    reach = codes.reach(radius)

    @F.pandas_udf("array<int>")
    def near(part: pd.Series, value: pd.Series) -> pd.Series:
        """The prefixes that a substring's value may have within its reach; made in the task, as there may be thousands."""
        flips = {r: masks(lead, r) for r in set(reach) if r >= 0}
        return pd.Series([flips[reach[p]] ^ np.int32(v >> (codes.width - lead)) if reach[p] >= 0 else [] for p, v in zip(part, value)], dtype=object)

    probes = asked.select("uid", "id", "x", "subs", F.posexplode("subs").alias("part", "value"))
    probes = probes.select("uid", "id", "x", "subs", "part", F.explode(near("part", "value")).alias("prefix")).join(small_side(shards), ["part", "prefix"])
    probes = probes.withColumn("shard", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("salts") - 1)))
    probes = probes.select("shard", F.lit(1).alias("kind"), "part", "uid", "id", "x", "subs")
    both = own.unionByName(probes).repartitionById(total, "shard").sortWithinPartitions("shard", "kind", "uid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows of a shard come first, then the queries, a batch at a time.
        at, held, index = None, [], None
        for batch in batches:
            for (shard, kind), part in batch.groupby(["shard", "kind"], sort=True):
                if shard != at:
                    at, held, index = shard, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue
                    mine, held = pd.concat(held), []
                    index = Shard(codes, int(mine["part"].iloc[0]), mine["uid"].to_numpy(), mine["id"].to_numpy(), np.array(mine["subs"].tolist(), np.int32), np.array(mine["x"].tolist(), float))
                asking = zip(part["uid"], part["subs"], part["x"])
                out = [r for uid, code, x in asking for r in index.search(int(uid), np.asarray(code, np.int32), np.asarray(x, float), radius, k)]
                yield pd.DataFrame(out, columns=["uid", "other", "vec_id", "score"])

    found = both.mapInPandas(run, "uid bigint, other bigint, vec_id bigint, score double")
    best = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("uid", "rank", "vec_id", "score")
