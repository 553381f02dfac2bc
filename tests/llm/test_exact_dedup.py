import hashlib
import re

import pytest
from helpers import documents
from pyspark.sql import functions as F

from threadlens.llm.exact_dedup import dedup, identities, keep_first


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    out = []
    for r in rows:
        ids = groups[norm(r[1])]
        out.append((r[0], min((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 64, 8192])
def test_matches_brute_force(spark, edge_rows, block):
    got = dedup(documents(spark, edge_rows), block).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(edge_rows)
    # One row of each group is kept.
    assert sum(r.kept for r in got) == len({norm(r[1]) for r in edge_rows})


def test_digest_collisions_do_not_merge_texts(spark, edge_rows):
    weak = lambda block: F.substring(F.sha2(block, 256), 1, 1)
    got = dedup(documents(spark, edge_rows), 16, weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(edge_rows)


def test_names_are_collision_free(spark):
    # Equal halves in other orders must not share a name.
    texts = ["aabb", "bbaa", "aaaa", "bbbb", "aab", "baa", "aabbaabb", "aabbbbaa"]
    got = identities(documents(spark, list(enumerate(texts))), 2).collect()
    assert len({(r.blocks, r.name) for r in got}) == len(texts)


def test_names_are_ranks_for_every_partitioning(spark):
    rows = [(k, f"text {k % 23} " * (1 + k % 5)) for k in range(200)]
    found = []
    for parts in (1, 3, 11):
        docs = documents(spark, rows).repartition(parts, F.hash("doc_id", F.lit(parts)))
        found.append({r.doc_id: (r.blocks, r.name) for r in identities(docs, 16).collect()})
        single = {r.name for r in identities(documents(spark, rows).repartition(parts), 10_000).collect()}
        assert single == set(range(len({t for _, t in rows})))
    assert found[0] == found[1] == found[2]


def test_keep_first_keeps_whole_rows(spark, edge_rows):
    docs = documents(spark, edge_rows)
    got = keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(norm(r.text) for r in got.collect()) == sorted({norm(r[1]) for r in edge_rows})


def test_empty_table(spark):
    assert dedup(documents(spark, [])).collect() == []
    assert keep_first(documents(spark, [])).collect() == []
