import random

from helpers import documents
from pyspark.sql import functions as F
from test_simhash import roots

import corpus_pipeline
from threadlens.llm import simhash, similar
from threadlens.llm.base import PART_ROWS, PARTS, packed


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def test_stage_drops_near_copies_at_similarity(spark, edge_rows, tmp_path):
    """Families around and beyond the threshold, exact at 0.8, and odd rows; brute force over all pairs."""
    rng = random.Random(3)
    rows = list(edge_rows) + [(50, "a b c d e f g h", "s"), (51, "z a b c d e f g h", "s"), (52, "A b  c d e f g h", "s")]
    for base in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for k in range(25):
            copy = list(words)
            for _ in range(k % 9):
                copy[rng.randrange(150)] = f"x{rng.randrange(5000)}"
            rows.append((100 + 30 * base + k, " ".join(copy), "s"))
    texts = sorted({" ".join((r[1] or "").lower().split()) for r in rows})
    sets = [shingle_set(t) for t in texts]
    near = [(texts[a], texts[b]) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    comp = roots(texts, near)
    assert comp["a b c d e f g h"] == comp["z a b c d e f g h"] and len(set(comp.values())) < len(texts) - 40
    least = {}
    for r in rows:
        c = comp[" ".join((r[1] or "").lower().split())]
        least[c] = min(least.get(c, (True, 0)), (r[0] is None, r[0] or 0))
    docs = documents(spark, rows)
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(least.values())


def test_bitmaps_never_overstate(spark):
    rng = random.Random(1)
    for _ in range(50):
        a = {rng.getrandbits(64) for _ in range(rng.randrange(300))}
        b = set(rng.sample(sorted(a), len(a) * 3 // 4)) | {rng.getrandbits(64) for _ in range(rng.randrange(50))}
        bits = [similar.bitmap(similar.np.array(sorted(s), "u8")) for s in (a, b)]
        assert sum(bin(int(x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(*bits)) <= len(a ^ b)


def test_stage_takes_candidates_from_the_pivots(spark, monkeypatch):
    """Near copies within two bits are found by the pivots alone, where no band is shared."""
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words), "s"), (2, " ".join([*words, "w0"]), "s"), (3, " ".join(f"v{k}" for k in range(50)), "s"), (4, " ".join(words).upper(), "s")]
    a, b = (similar.majority(similar.hashes_of(r[1], 5)) for r in rows[:2])
    assert [similar.majority(similar.hashes_of(r[1], 5)) for r in rows] == [simhash.fingerprint(r[1], 5) for r in rows]
    assert bin(a ^ b).count("1") <= simhash.RADIUS and similar.majority(similar.hashes_of("", 5)) == 0
    monkeypatch.setattr(similar, "_sketches", lambda *x, made=similar._sketches: made(*x).withColumn("keys", F.array().cast("array<bigint>")))
    got = simhash.keep_one(documents(spark, rows), 5, similarity=0.8).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


def test_small_steps_read_few_parts(spark):
    """However many partitions the session shuffles into, what small steps leave is read in few parts."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 30)]
        got = simhash.components(spark.createDataFrame(edges, "a bigint, b bigint"))
        assert got.rdd.getNumPartitions() <= PARTS
        want, found = roots({n for e in edges for n in e}, edges), {r.node: r.root for r in got.collect()}
        assert {n: found.get(n, n) for n in want} == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    many = spark.range(100, numPartitions=50)
    assert packed(many, 20 * PART_ROWS + 1).rdd.getNumPartitions() == 21 and packed(many, 10**9).rdd.getNumPartitions() == 50
