import random
import re

import pytest
import xxhash
from helpers import documents

from threadlens.llm.simhash import components, fingerprint, keep_one, links, near_duplicates


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint(edge_rows):
    for _, text, *_ in edge_rows:
        assert fingerprint(text or "") == plain_fingerprint(text)


@pytest.mark.parametrize("bucket", [0, 4, 32])
def test_links_lose_nothing(spark, bucket):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(25)] + [0, (1 << 64) - 1]
    # Families of one to five flips each, so that pairs lie on both sides of the radius.
    fps = set(base)
    for b in base:
        for _ in range(rng.choice([0, 3, 40])):
            x = b
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(map(signed, fps))
    near = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    got = [(r.a, r.b) for r in links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), bucket).collect()]
    assert roots(fps, got) == roots(fps, near)
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in got)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (202, 201), (203, 202), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots({n for e in edges for n in e}, edges)
    assert {n: got.get(n, n) for n in want} == want


def test_documents_match_brute_force(spark, edge_rows):
    rng = random.Random(4)
    words = [rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(400)]
    rows = list(edge_rows)
    for k in range(40):
        copy = list(words)
        for _ in range(k % 5):
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((1000 - k, " ".join(copy)))
    got = near_duplicates(documents(spark, rows)).collect()
    fps = {plain_fingerprint(r[1]) for r in rows}
    comp = roots(fps, [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2])
    least = {}
    for r in rows:
        if r[0] is not None:
            c = comp[plain_fingerprint(r[1])]
            least[c] = min(r[0], least.get(c, r[0]))
    want = [(r[0], f"{plain_fingerprint(r[1]):016x}", least.get(comp[plain_fingerprint(r[1])])) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert len(kept.collect()) == len(set(comp.values()))


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).collect() == []
    assert keep_one(documents(spark, [])).collect() == []
