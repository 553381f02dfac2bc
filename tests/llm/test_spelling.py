import random
import re
import zlib
from collections import Counter

import pytest
from helpers import documents

from threadlens.llm import spelling
from threadlens.llm.queries import QUERIES


def edits(a, b):
    """True if b is a with exactly one letter inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, planted):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if planted and h % planted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute(n):
    out, form = [], {}
    for w in n:
        near = sorted((-n[v], v) for v in n if v != w and edits(w, v))
        if near and -near[0][0] >= 2 * n[w]:
            form[w] = near[0][1]
        out.append((w, len(near)))
    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, form.get(w), root(w), n[w], k, n[form[w]] if w in form else None) for w, k in out)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def prose(seed, rows, letters="abé"):
    """Short alphabet, so that many words are near and letters repeat."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 5, 6, 6, 7, 8]))) for _ in range(150)]
    return [(i, " ".join(rng.choice(words).capitalize() if rng.random() < 0.2 else rng.choice(words) for _ in range(60)) + ", 12x") for i in range(rows)]


@pytest.mark.parametrize(("planted", "shard"), [(97, 20_000), (5, 20_000), (5, 6)])
def test_equals_brute_force(spark, planted, shard):
    rows = prose(planted, 60)
    got = found(spelling.variants(documents(spark, rows), planted, shard_words=shard))
    assert got == brute(brute_words(rows, planted))
    assert any(r[1] for r in got)


def test_merge_finds_each_pair_once():
    rng = random.Random(3)
    for letters in ("ab", "abcdef"):
        words = {"".join(rng.choice(letters) for _ in range(rng.choice([5, 6]))) for _ in range(300)}
        counts = {w: rng.randrange(3, 50) for w in words}
        near = spelling.merge(sorted(words), counts, 5)
        for w in words:
            want = sorted((-counts[v], v) for v in words if edits(w, v) and min(len(w), len(v)) == 5)
            have = near.of.get(w)
            assert (have is None) == (not want)
            if want:
                assert have == [len(want), -want[0][0], want[0][1]]


def test_long_runs_of_one_letter(spark):
    text = " ".join(["a" * k for k in (5, 6, 7, 40, 41)] * 3 + ["b" * 5_000, "b" * 5_001] * 3)
    got = found(spelling.variants(documents(spark, [(1, text)]), shard_words=2))
    assert got == brute(brute_words([(1, text)], 0))


def test_chains_of_forms_end_at_one_root(spark):
    words = ["abcde"] * 3 + ["abcdf"] * 6 + ["abcgf"] * 12 + ["abhgf"] * 24 + ["aihgf"] * 48
    got = found(spelling.variants(documents(spark, [(1, " ".join(words))])))
    assert {r[2] for r in got} == {"aihgf"} and got == brute(brute_words([(1, " ".join(words))], 0))


def test_odd_rows(spark, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows] + [(None, "theré theré theré there there there"), (99, "THERE ×÷×÷× " * 3)]
    assert found(spelling.variants(documents(spark, rows), 7)) == brute(brute_words(rows, 7))
    assert found(spelling.variants(documents(spark, []), 97)) == []
    assert found(spelling.variants(documents(spark, [(1, None), (2, ""), (3, "12 34")]), 97)) == []


def test_query_over_a_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n = brute_words(docs, 97)
    got = found(QUERIES["op12_spelling_variants"](spark, sf_dir))
    assert [(r[0], r[3]) for r in got] == sorted(n.items())
    some = {r[0] for r in got if r[4]} | set(sorted(n)[::40])
    for w, form, root, _, n_near, form_n in got:
        if w in some:
            near = sorted((-n[v], v) for v in n if abs(len(v) - len(w)) < 2 and v != w and edits(w, v))
            assert n_near == len(near)
            want = near[0][1] if near and -near[0][0] >= 2 * n[w] else None
            assert (form, form_n) == (want, n.get(want))
            assert want is not None or root == w
