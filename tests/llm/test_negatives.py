import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, uid string, score string, block string, anchor string, dim string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "u", "s", "b", "a", "d") for r in rows], SCHEMA)


def brute(rows, every=5, positives=5, kept=3):
    """Plain loops over the rules: {(anchor, positive, rank, negative, positive score, negative score)}."""
    good = []
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            good.append((i, [math.floor(256 * float(np.float32(c))) for c in x], label))
    out = []
    for n, (a, q, label) in enumerate(good):
        if a % every:
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, r)), i, other == label) for m, (i, r, other) in enumerate(good) if m != n and len(r) == len(q))
        for ps, p, _ in [s for s in scored if s[2]][:positives]:
            fit = [(s, i) for s, i, same in scored if not same and 50 * -ps <= 100 * -s <= 95 * -ps]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(fit[:kept])]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vectors(seed, rows, dim, labels=4):
    """A few directions with noise, some rows twice."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((6, dim))
    out = []
    for i in range(rows):
        x = out[rng.integers(len(out))][1] if out and rng.random() < 0.1 else [float(v) for v in np.float32(0.3 * (middle[rng.integers(6)] + 0.7 * rng.standard_normal(dim)))]
        out.append((i, x, int(rng.integers(labels)) if rng.random() < 0.6 else 0))
    return out


@pytest.mark.parametrize(("dim", "cells", "group"), [(12, 1 << 18, 1 << 22), (12, 300, 200), (1, 40, 10)])
def test_equals_brute_force_for_any_blocks_and_groups(spark, dim, cells, group):
    rows = vectors(dim, 260, dim)
    got = negatives.mine(table(spark, rows), F.col("vec_id") % 5 == 0, least_cells=cells, block_cells=cells, group_cells=group, sample_rows=100)
    assert found(got) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(3, 60, 4)
    rows += [(100, None, 1), (105, [], 0), (110, [], 1), (115, [], 0), (None, [1.0, 1.0, 1.0, 1.0], 0), (120, [1.0, None, 0.0, 0.0], 0), (125, [float("nan"), 1.0, 1.0, 1.0], 0)]
    rows += [(130, [float("inf"), 1.0, 1.0, 1.0], 0), (135, [0.0] * 4, 2), (140, [0.0] * 4, 3), (145, [1.0, 1.0, 1.0, 1.0], None), (150, [0.5, 0.5], 0), (155, [0.5, 0.4], 0), (160, [0.5, 0.35], 1)]
    random.Random(1).shuffle(rows)
    got = found(negatives.mine(table(spark, rows), F.col("vec_id") % 5 == 0))
    assert got == brute(rows)
    assert {r[0] for r in got} >= {105, 115, 150}


def test_far_components_take_no_part_and_large_ones_are_exact(spark):
    big = negatives.limit(2) / 256
    rows = [(0, [big * 0.9, 3.0], 0), (1, [big * 0.9, 1.0], 0), (2, [big * 0.6, 7.0], 1), (3, [1e30, 1.0], 1), (5, [-1e30, 0.0], 0)]
    got = found(negatives.mine(table(spark, rows), F.col("vec_id") % 5 == 0))
    assert got == brute(rows[:3])
    assert len(got) == 1 and got[0][4] > 2**61


def test_empty_and_lonely(spark):
    assert found(negatives.mine(table(spark, []), F.col("vec_id") % 5 == 0)) == []
    assert found(negatives.mine(table(spark, [(0, [1.0], 1), (1, [1.0], 2)]), F.col("vec_id") % 5 == 0)) == []


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (1, [0.8, 0.1], 0), (2, [0.7, 0.1], 1), (2, [0.7, 0.1], 1), (3, [0.6, 0.0], 1)]
    assert found(negatives.mine(table(spark, rows), F.col("vec_id") % 5 == 0)) == brute(rows)


def test_pruning_bounds_hold_and_discard():
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((300, 32)) * np.geomspace(200, 1, 32)).astype(np.int64)
    turn, ends = negatives.axes(x), negatives.step_ends(32)
    a, r = negatives.Rotated(x[:20], turn, ends), negatives.Rotated(x, turn, ends)
    true = x[:20] @ x.T
    low = np.sort(true, 1)[:, -5]
    i, j = negatives.survivors(a, r, ends, np.ones(true.shape, bool), low.astype(float), np.full(20, np.inf))
    assert set(zip(i, j)) == set(zip(*np.nonzero(true >= low[:, None])))
    first = a.y[:, : ends[0]] @ r.y[:, : ends[0]].T + np.outer(a.left[:, 0], r.left[:, 0])
    assert (first >= low[:, None]).mean() < 0.3  # most pairs go after the first step


def test_query_equals_its_sql(spark, sf_dir):
    import duckdb
    from threadlens.llm.queries import ORACLES, QUERIES

    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = duckdb.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({ORACLES['op11_hard_negatives']})").fetchall()
    assert want and found(QUERIES["op11_hard_negatives"](spark, sf_dir)) == sorted(want)
