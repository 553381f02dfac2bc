"""Near copies by the Jaccard similarity of word shingles, verified exactly.

Texts are compared as sets of hashed shingles.  Candidates come from the pivot
distance tables of their SimHashes (module simhash) and are verified here.  At a
similarity of 0.8, though, about ten of 64 bits differ and no 16-bit segment
need agree, so the rest of the candidates share a band: ROWS equal minima of
random orders (MinHash).  There are as many bands as leave a pair just at the
wanted similarity unseen with a chance of MISSED (32 at 0.8).

In each bucket every member is first held against the smallest and the largest
one, which ties a family of near copies together without pairing it up.  Members
that lie in other components yet are held against HUBS members more, where many
more pairs than members are left: of a family whose members are near enough to
many others, that leaves hardly any.  Then all pairs
of a bucket that still lie in different components are compared, so no link
between components is left out.  Before shingles are fetched, parity bitmaps
throw pairs out: shingles that two sets share cancel out, so the bits that
differ are never more than the shingles that differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, cut_packed, is_empty, matching, small_batches, small_side

SEED, ROWS, MISSED = 42, 4, 5e-8
#: Words of 64 bits in a parity bitmap.
BITMAP = 16
#: Rounds, further members of each bucket in one, and pairs between components for each member that a round is worth.
ROUNDS, HUBS, ROUND_PAIRS = 1, 24, 64


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def text_key(text: str) -> int:
    """Unsigned 64-bit hash of a text; texts that differ in ASCII case and white space only have the same one."""
    return xxhash.xxh64_intdigest(b" ".join(_words(text)), SEED)


def hashes_of(text: str, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a whole text in order, repeats too.  A shorter text is one shingle; no words, none."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    count = max(1, len(words) - shingle + 1)
    return np.fromiter((digest(b" ".join(words[k : k + shingle]), SEED) for k in range(count)), np.uint64, count)


def shingles(text: str, shingle: int) -> np.ndarray:
    """Distinct hashes of the shingles of a whole text, ascending."""
    return np.unique(hashes_of(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of a text by its hashes: the bits that are set in over half of them; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def bands_for(similarity: float) -> int:
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-(min(similarity, 0.99) ** ROWS))))


def _orders(bands: int) -> tuple[np.ndarray, np.ndarray]:
    draw = lambda seed: np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "big"), seed) for k in range(bands * ROWS)], np.uint64)
    return draw(1) | np.uint64(1), draw(2)


def band_keys(hashes: np.ndarray, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A signed key for each band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    times, plus = orders
    least = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):  # pieces that fit the processor's cache
        least = np.minimum(least, (hashes[at : at + 256, None] * times + plus).min(0))
    return np.array([xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), k) for k in range(0, len(times), ROWS)], np.uint64).view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITMAP signed longs whose bits are the parities of the counts of hashes that fall on them."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches(docs: DataFrame, shingle: int, bands: int) -> DataFrame:
    """(doc_id, fp, sim, keys): fp is the text's key as a signed long, sim its SimHash, keys are those of its bands."""
    orders = _orders(bands)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            fps = np.array([text_key(t) for t in texts], np.uint64).view(np.int64)
            sims, keys = [], []
            for t in texts:
                hashes = hashes_of(t, shingle)
                sims.append(majority(hashes))
                keys.append(band_keys(np.unique(hashes), orders))
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "fp": fps, "sim": np.array(sims, np.uint64).view(np.int64), "keys": keys})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, fp bigint, sim bigint, keys array<bigint>")


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(fp, n, b0..b7, shingles) for each of the wanted texts (fp), once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t or "", shingle) for t in batch["text"]]
            maps = np.array([bitmap(s) for s in sets], np.int64).reshape(-1, BITMAP)
            out = {"fp": np.array([text_key(t or "") for t in batch["text"]], np.uint64).view(np.int64), "n": [len(s) for s in sets]}
            yield pd.DataFrame(out | {f"b{k}": maps[:, k] for k in range(BITMAP)} | {"shingles": [s.view(np.int64) for s in sets]})

    ids = small_side(cut(rows.select("doc_id", "fp").join(wanted, "fp", "left_semi").select("doc_id").distinct()))
    picked = docs.select("doc_id", "text").alias("d").join(ids.alias("k"), matching("d", "k", "doc_id"), "left_semi")
    columns = ", ".join(f"b{k} bigint" for k in range(BITMAP))
    made = small_batches(picked.select("text")).mapInPandas(run, f"fp bigint, n bigint, {columns}, shingles array<bigint>")
    return cut(made.join(wanted, "fp", "left_semi").dropDuplicates(["fp"]))


def _possible(a: str, b: str, share: Fraction) -> Column:
    """Whether two sets can have the similarity, by the sizes and bitmaps of two aliased frames."""
    apart = sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(BITMAP)), F.lit(0))
    p, q = share.numerator, share.denominator
    spare = (F.col(f"{a}.n") + F.col(f"{b}.n")) * (q - p)
    return (F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) * (q + p) <= spare) & (apart * (q + p) <= spare)


def _verified(pairs: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """Of the pairs (a, b) those with the similarity, by all their shingles."""
    p, q = share.numerator, share.denominator
    x = pairs.alias("p").join(sets.alias("x"), F.col("p.a") == F.col("x.fp"))
    both = x.join(sets.alias("y"), (F.col("p.b") == F.col("y.fp")) & _possible("x", "y", share))
    shared = F.size(F.array_intersect("x.shingles", "y.shingles"))
    return both.where(shared * (p + q) >= (F.col("x.n") + F.col("y.n")) * p).select("p.a", "p.b")


def _open_buckets(placed: DataFrame) -> DataFrame:
    """key, large: buckets whose members (key, fp, root) lie in several components, and whether further hubs are worth it."""
    n = F.col("n").cast("double")
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    spread = sizes.groupBy("key").agg(F.sum(n).alias("all"), F.sum(n * n).alias("own"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    return spread.select("key", ((F.col("all") * F.col("all") - F.col("own")) / 2 > ROUND_PAIRS * F.col("all")).alias("large"))


def by_pivots(rows: DataFrame, pivots) -> DataFrame:
    """(a, b): pairs of texts (fp) that the SimHash pivots link, one or two for each text of a group, to be verified.

    ``pivots``: a function of distinct SimHashes (fp) that gives the links (a, b)
    between them.  Every text meets the smallest one of its SimHash, and that one
    the smallest of the least SimHash it is linked with.
    """
    texts = rows.select("sim", "fp")
    tops = cut_packed(texts.groupBy("sim").agg(F.min("fp").alias("top")))
    near = cut_packed(pivots(tops.select(F.col("sim").alias("fp"))).groupBy(F.col("b").alias("sim")).agg(F.min("a").alias("other")))
    tops = small_side(tops)
    twins = texts.join(tops, "sim").where("fp <> top").select("fp", F.col("top").alias("end"))
    across = near.join(tops, "sim").join(tops.select(F.col("sim").alias("other"), F.col("top").alias("end")), "other").select(F.col("top").alias("fp"), "end")
    return twins.unionByName(across).select(F.least("fp", "end").alias("a"), F.greatest("fp", "end").alias("b")).distinct()


def links(docs: DataFrame, rows: DataFrame, shingle: int, similarity: float, components, pivots) -> DataFrame:
    """(a, b): edges that connect the keys of texts of at least that Jaccard similarity.  ``rows`` are the sketches.

    Candidates come from the SimHash pivots, and from bands what those can't see.
    """
    share = Fraction(str(similarity))
    close = cut_packed(by_pivots(rows, pivots))
    spread = rows.select("fp", F.explode("keys").alias("key"))
    buckets = cut_packed(spread.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high"))
    members = cut_packed(spread.join(small_side(buckets), "key").distinct())
    wanted = members.select("fp").unionByName(close.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    sets = _sets(docs, rows, cut_packed(wanted), shingle)
    ends = members.select("fp", F.explode(F.array("low", "high")).alias("end")).where("fp <> end")
    stars = ends.select(F.least("fp", "end").alias("a"), F.greatest("fp", "end").alias("b")).distinct()
    found = cut_packed(_verified(close.unionByName(stars).distinct(), sets, share))
    roots = components(found)
    placed = members.select("key", "fp").join(roots, members["fp"] == roots["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    maps = sets.drop("shingles")
    found = [found]
    for turn in range(ROUNDS + 1):
        placed = cut_packed(placed.join(small_side(cut_packed(_open_buckets(placed))), "key"))
        if is_empty(placed):
            break
        large = placed.where("large")
        if turn < ROUNDS and not is_empty(large):
            drawn = F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("fp", F.lit(HUBS * turn + k)).alias("h"), "fp", "root")) for k in range(HUBS)]))
            hubs = large.groupBy("key").agg(drawn.alias("hubs")).select("key", F.inline("hubs")).select("key", F.col("fp").alias("hub"), F.col("root").alias("hub_root"))
            ends = large.join(small_side(hubs.distinct()), "key").select("fp", "root", "hub", "hub_root").where("root <> hub_root").distinct()
            near = ends.join(maps.alias("x"), F.col("x.fp") == ends["fp"]).join(maps.alias("y"), F.col("y.fp") == ends["hub"]).where(_possible("x", "y", share))
            near = cut_packed(near.select(F.least(ends["fp"], "hub").alias("a"), F.greatest(ends["fp"], "hub").alias("b"), "root", "hub_root").distinct())
            new = cut_packed(_verified(near.select("a", "b").distinct(), sets, share))
            if not is_empty(new):
                found.append(new)
                joined = components(near.join(new, ["a", "b"]).select(F.col("root").alias("a"), F.col("hub_root").alias("b")))
                placed = placed.join(joined, placed["root"] == joined["node"], "left").select("key", "fp", F.coalesce(joined["root"], placed["root"]).alias("root"))
                continue
        open_ = cut_packed(placed.join(maps, "fp"))
        a, b = open_.alias("a"), open_.alias("b")
        on = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.root") != F.col("b.root")) & _possible("a", "b", share)
        across = a.join(b.hint("merge"), on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()
        found.append(cut(_verified(across, sets, share)))
        break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def sketched(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    return cut(_sketches(docs, shingle, bands_for(similarity)))
