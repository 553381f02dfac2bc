"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets a table of Hamming distances to PIVOTS fixed
reference fingerprints, one distance for each of four 16-bit segments.  Two
fingerprints that differ in at most two bits agree in at least two segments,
so they have equal distances to every reference there: joining on the distance
vectors of each of the six pairs of segments loses no link.  Joined pairs whose
distances over all bits differ by more than two for any reference are thrown
out (the triangle inequality); survivors are verified bit by bit.

A bucket of more than BUCKET fingerprints, as a large family of near copies
makes, is not paired up.  Its members instead meet at centres: a fingerprint
goes to itself and to each of its 64 one-bit neighbours.  Two fingerprints
within two bits share a centre, and all that share a centre are within two
bits of each other, so a star round each centre carries exactly the same
links with 65 rows a member.

Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import similar
from .base import cut, cut_packed, free_name, is_empty, matching, packed, small_batches

#: Words in a shingle, seed of its hash, and differing bits that still link.
SHINGLE, SEED, RADIUS = 3, 42, 2
PIVOTS = 12
BUCKET = 32
_SEGMENTS = 4


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Reference fingerprints: hashes of 0, 1, 2 and so on.
REFERENCES = [_signed(xxhash.xxh64_intdigest(bytes([k]), SEED)) for k in range(PIVOTS)]
_MASKS = [_signed(0xFFFF << (16 * s)) for s in range(_SEGMENTS)]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    stops = (ends[shingle - 1 :] - 1).tolist()
    for at in range(0, len(starts), 65536):  # bounded memory for very long texts
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long.  Null text has fingerprint zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t or "", shingle) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "fp": fps.view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, fp bigint")


def _distance(fp: Column, reference: int, mask: int | None = None) -> Column:
    x = fp.bitwiseXOR(F.lit(reference).cast("long"))
    return F.bit_count(x if mask is None else x.bitwiseAND(F.lit(mask).cast("long")))


def pivot_table(vertices: DataFrame) -> DataFrame:
    """fp, s0..s3 (packed segment distances to all references), d0..d11 (distances over all bits)."""
    fp = F.col("fp")
    cols = [fp]
    for s, mask in enumerate(_MASKS):
        packed = F.lit(0).cast("long")
        for k, ref in enumerate(REFERENCES):
            packed = packed + _distance(fp, ref, mask).cast("long") * F.lit(1 << (5 * k)).cast("long")
        cols.append(packed.alias(f"s{s}"))
    return vertices.select(*cols, *[_distance(fp, ref).cast("byte").alias(f"d{k}") for k, ref in enumerate(REFERENCES)])


def links(vertices: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints within RADIUS bits (column fp, distinct)."""
    pairs = [(i, j) for i in range(_SEGMENTS) for j in range(i + 1, _SEGMENTS)]
    table = pivot_table(vertices)
    keys = F.array(*[F.struct(F.lit(n).alias("pair"), F.col(f"s{i}").alias("x"), F.col(f"s{j}").alias("y"), F.lit(_MASKS[i] | _MASKS[j]).cast("long").alias("mask")) for n, (i, j) in enumerate(pairs)])
    rows = table.select("fp", *[f"d{k}" for k in range(PIVOTS)], F.inline(keys))
    counts = cut_packed(rows.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    small, large = counts.where(F.col("n") <= bucket), counts.where(F.col("n") > bucket)
    shared = cut_packed(rows.join(small.drop("n"), ["pair", "x", "y"]))
    a, b = shared.alias("a"), shared.alias("b")
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    near = [F.abs(F.col(f"a.d{k}") - F.col(f"b.d{k}")) <= RADIUS for k in range(PIVOTS)]
    on = (F.col("a.pair") == F.col("b.pair")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.fp") < F.col("b.fp"))
    for c in near:
        on = on & c
    # Verified, and taken only where the two segments agree in truth.
    on = on & (F.bit_count(apart) <= RADIUS) & (apart.bitwiseAND(F.col("a.mask")) == 0)
    found = a.join(b.hint("merge"), on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if is_empty(large):
        return found
    members = rows.select("fp", "pair", "x", "y").join(large.drop("n"), ["pair", "x", "y"]).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)).cast("long") for k in range(64)])
    centres = cut(members.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")))
    hubs = centres.groupBy("centre").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # At most 65 fingerprints share a centre.
    stars = centres.join(hubs.hint("merge"), "centre").where("fp <> a").select("a", F.col("fp").alias("b"))
    return found.unionByName(stars)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component, for each node with an edge.

    Alternates large-star and small-star (each node sends its neighbours to
    its smallest one) until nothing changes.  The neighbours of a hub are
    never gathered: its minimum is a combined aggregate, joined back.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    most = edges.count()  # neither step makes more edges than it is given
    edges = packed(edges, most)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = cut(packed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), most))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        small = cut(packed(small.distinct(), most))
        # Done when every node points to one root and no root points on.
        ends = small.select("u", F.lit(1).alias("out"), F.lit(0).alias("top")).unionByName(small.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("top")))
        if is_empty(packed(ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("top").alias("top")).where("out > 1 OR out > 0 AND top > 0"), 2 * most)):
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = small


def _assigned(docs: DataFrame, shingle: int, bucket: int, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, fp) of every row, (fp, root) of every fingerprint).

    With a similarity, fp is ``similar.text_key`` and links are near copies by it:
    those that links() finds among the SimHashes, verified, and the rest by bands.
    """
    rows = cut(fingerprints(docs, shingle)) if similarity is None else similar.sketched(docs, shingle, similarity)
    vertices = cut(rows.select("fp").distinct())
    edges = links(vertices, bucket) if similarity is None else similar.links(docs, rows, shingle, similarity, components, lambda sims: links(sims, bucket))
    roots, rows = components(edges), rows.select("doc_id", "fp")
    return rows, cut(vertices.join(roots, vertices["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of (doc_id, text).

    component_id is the smallest doc_id reachable over links, the row's own
    included.  Null and empty texts have fingerprint zero and link like any
    other.  Null ids are never a smallest id: a component of null ids only has
    a null component_id.  Repeated ids keep one row each.  Empty input gives an
    empty result.
    """
    rows, roots = _assigned(docs, shingle, bucket)
    # Ids are first reduced to one for each fingerprint, so that no large family meets in one task.
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tops = least.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    ids = cut(roots.join(tops, "root").select("fp", "component_id"))
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each component the one with the smallest doc_id.

    Links are fingerprints within RADIUS bits or, with a similarity, texts whose
    sets of shingles have at least that Jaccard similarity: pivots come first,
    and what they can't see by bands (module ``similar``).

    A null id comes after all others; rows that tie in id (or have none) go by
    fingerprint, and of rows equal in both any one stays.
    """
    rows, roots = _assigned(docs, shingle, bucket, similarity)
    digest = similar.text_key if similarity is not None else lambda text: fingerprint(text, shingle)
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")).alias("first"))
    kept = first.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first"))
    fp = free_name(docs, "fp")
    kept = cut(kept.select(F.col("first.doc_id").alias("doc_id"), F.col("first.fp").alias(fp)))
    if is_empty(rows.groupBy("doc_id").count().where("count > 1")):  # an id tells its row, so no text is read again
        return docs.alias("d").join(kept.select("doc_id").alias("k").hint("merge"), matching("d", "k", "doc_id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([digest(t or "") for t in batch.column("text").to_pylist()], np.uint64)
            yield batch.append_column(fp, pa.array(fps.view(np.int64)))

    marked = small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    out = marked.alias("d").join(kept.alias("k").hint("merge"), matching("d", "k", "doc_id", fp), "left_semi")
    if not is_empty(rows.groupBy("doc_id", "fp").count().where("count > 1")):
        out = out.dropDuplicates(["doc_id", fp])
    return out.drop(fp)
