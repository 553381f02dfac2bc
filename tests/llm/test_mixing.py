import hashlib
import re

from helpers import documents

from threadlens.llm.mixing import mix, mixed, schedule, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def brute_targets(sizes):
    """sizes: {source: words}; shares the budget round by round until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        if not rest:
            return capped
        left = budget - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = [s for s in rest if share[s] >= 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def brute_taken(rows, seed=42):
    """Walks each source's shuffled stream until its goal is used up."""
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + size(r[1])
    goal = {s: int(t + 0.5) for s, t in brute_targets(sizes).items()}
    key = lambda r: hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    taken = []
    for s in sizes:
        start = 0
        for r in sorted((r for r in rows if r[2] == s), key=key):
            n = size(r[1])
            took = [max(0, min(n, goal[s] - e * sizes[s] - start)) for e in range(2)]
            taken.append((r[0], n, sizes[s], round(brute_targets(sizes)[s], 6), sum(took)))
            start += n
    return sorted(taken, key=str)


def test_matches_brute_force(spark, edge_rows):
    rows = [(k, t, s) for k, (_, t, s) in enumerate(edge_rows)]  # repeated ids tie
    for words, chunk in ((3, 2), (64, 5), (1024, 20_000)):
        got = mix(documents(spark, rows), block_words=words, chunk_rows=chunk).collect()
        assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == brute_taken(rows)
        assert all(sum(r.epochs) == r.taken <= 2 * r["size"] for r in got)


def test_repeated_and_null_ids_keep_their_rows(spark, edge_rows):
    got = mix(documents(spark, edge_rows), block_words=8).collect()
    assert len(got) == len(edge_rows)
    by_source = {}
    for r in got:
        by_source.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by_source.items():
        assert abs(sum(taken) - target) <= 1


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 600, None: 3}
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    want = brute_targets(sizes)
    assert {r.source: round(r.target, 9) for r in got} == {s: round(t, 9) for s, t in want.items()}


def test_schedule_spreads_sources(spark):
    plan = spark.createDataFrame([("x", 600, 900), ("y", 300, 300), ("z", 50, 100)], "skey string, source_size bigint, goal bigint")
    slots = sorted(schedule(spark, plan, 10).collect(), key=lambda r: r.slot)
    assert sum(r.words for r in slots) == 1300
    # In any prefix the share of x stays near 90/130.
    seen = 0
    for k, r in enumerate(slots, 1):
        seen += r.skey == "x"
        assert abs(seen - k * 90 / 130) <= 6
    ranks = [r["rank"] for r in slots if r.skey == "x"]
    assert ranks == list(range(90))


def test_mixed_rows_hold_the_taken_words(spark, edge_rows):
    docs = documents(spark, edge_rows)
    got = mixed(docs, block_words=8)
    assert got.columns == docs.columns
    words, want = {}, {}
    for r in got.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
    for r in mix(docs, block_words=8).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in want.items() if v} == words


def test_mixed_takes_what_mix_tells_of_repeated_ids(spark):
    # Every id in three sources; the second source is not taken whole.
    rows = [(k % 35, f"{s}{k} " * (3 + k % 7), s) for s in "abc" for k in range(40)] + [(None, "no id", "b"), (None, "no id", "b")]
    docs = documents(spark, rows)
    told, got = mix(docs, block_words=8).collect(), mixed(docs, block_words=8).collect()
    assert any(r.taken == 0 for r in told)
    words = lambda found: sorted(found, key=str)
    want = [(r.doc_id, r.skey[1:], n) for r in told for n in r.epochs]
    assert words((r.doc_id, r.source, size(r.text)) for r in got) == words(want)


def test_output_stands_in_the_order_of_the_schedule(spark, monkeypatch):
    monkeypatch.setattr("threadlens.llm.mixing.TASK_SLOTS", 16)
    rows = [(k, "w " * 10, "a" if k < 300 else "b" if k < 700 else "c") for k in range(1000)]
    out = mixed(documents(spark, rows), block_words=10)
    assert out.rdd.getNumPartitions() > 4
    got = [r.source for r in out.collect()]
    total = {s: got.count(s) for s in "abc"}
    assert sum(total.values()) == 1500
    for k in range(100, 1500, 100):  # the prefix holds each source nearly in proportion
        for s in "abc":
            assert abs(got[:k].count(s) - k * total[s] / 1500) <= 12


def test_empty_table(spark):
    assert mix(documents(spark, [])).collect() == []
    assert mixed(documents(spark, [])).collect() == []
