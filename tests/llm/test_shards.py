import pytest
from helpers import documents
from pyspark.sql import functions as F

from threadlens.llm.base import scratch
from threadlens.llm.shards import Conflict, ShardStore, Tiers, TypeChange, layout


def content(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def test_append_compact_and_read_versions(spark):
    rows = [(k, "x" * (k % 37 + 1), f"s{k % 3}") for k in range(600)]
    docs = documents(spark, rows)
    store = ShardStore(spark, scratch(spark, "store"))
    assert store.version() == 0 and store.manifest().collect() == []
    assert store.append(docs.where("doc_id < 400"), F.col("doc_id") % 5, shard_bytes=200, range_bytes=800) == 1
    assert store.append(docs.where("doc_id >= 400"), F.lit(9), shard_bytes=200, range_bytes=800) == 2
    small = store.manifest().collect()
    assert sum(r.rows for r in small) == 600 and len({r.run for r in small}) == len(small)
    before = content(store.rows())
    assert store.compact(target=3200, fanout=4, tiers=3) == 3
    runs = store.manifest().collect()
    assert len(runs) < len(small) / 3 and sum(r.rows for r in runs) == 600
    # At most fanout - 1 runs stay below the next tier.
    assert all(sum(r.bytes < 3200 / 4**t and r.bytes >= 3200 / 4 ** (t + 1) for r in runs) <= 3 for t in range(2))
    assert content(store.rows()) == before == content(store.rows(2)) and len(content(store.rows(1))) == 400
    assert sorted(r.doc_id for r in layout(store).collect()) == list(range(600))
    assert {r.bytes for r in store.manifest().collect()} == {r.run_bytes for r in layout(store).collect()}
    store.vacuum()
    assert content(store.rows()) == before
    assert store.compact(target=3200, fanout=4, tiers=3) in (3, 4)


def test_versions_are_taken_once(spark):
    store = ShardStore(spark, scratch(spark, "store"))
    store.append(documents(spark, [(1, "a")]), F.lit(0))
    with pytest.raises(Conflict):
        store._commit(store.manifest(), "late", 1, store.rows().schema)
    assert store.version() == 1 and [r.doc_id for r in store.rows().collect()] == [1]


def test_edges(spark, edge_rows):
    store = ShardStore(spark, scratch(spark, "store"))
    docs = documents(spark, edge_rows)
    store.append(docs, F.lit(None).cast("int"), shard_bytes=64, range_bytes=256)
    store.compact(target=1024, fanout=2, tiers=2)
    assert content(store.rows()) == content(docs)


def test_empty_table(spark):
    store = ShardStore(spark, scratch(spark, "store"))
    store.append(documents(spark, []), F.lit(0))
    assert store.compact() == 1
    assert layout(store).collect() == []


def test_own_names_and_large_arrivals(spark):
    store = ShardStore(spark, scratch(spark, "store"))
    rows = spark.createDataFrame([(1, "a", 123456, "r", 5, 6), (2, "b", -3, "r", 5, 6)], "doc_id int, text string, arrival int, run string, _size int, _order int")
    store.append(rows, F.col("arrival"))
    assert sorted(r.arrival for r in store.manifest().collect()) == [-3, 123456]
    assert sorted((r.doc_id, r.arrival, r._size, r._order) for r in store.rows().collect()) == [(1, 123456, 5, 6), (2, -3, 5, 6)]


def test_equal_arrival_numbers_never_share_a_run(spark):
    store = ShardStore(spark, scratch(spark, "store"))
    rows = [(k, f"t{k}", "s") for k in range(40)]
    for half in (rows[:20], rows[20:]):
        store.append(documents(spark, half), F.lit(0))
    assert store.compact(target=64, fanout=2, tiers=2) == 3
    assert content(store.rows()) == sorted(rows, key=str)


def test_append_and_compact_in_turn(spark):
    store = ShardStore(spark, scratch(spark, "store"))
    rows = [(k, "same", "s") for k in range(30)]
    for turn in range(3):
        store.append(documents(spark, rows[10 * turn : 10 * turn + 10]), F.lit(0), shard_bytes=8, range_bytes=8)
        store.compact(target=64, fanout=2, tiers=2)
        assert content(store.rows()) == sorted(rows[: 10 * turn + 10], key=str)
        store.vacuum()
    assert sum(r.rows for r in store.manifest().collect()) == 30


def test_writer_that_dies_leaves_no_version(spark):
    store = ShardStore(spark, scratch(spark, "store"))
    store.append(documents(spark, [(1, "a")]), F.lit(0))
    for name in (".append-dead", "v2.part"):  # what a dead writer, or one at work, has in the folder
        store._fs.create(store._path(f"{store.root}/commits/{name}"), False).close()
    assert store.version() == 1 and [r.doc_id for r in store.rows().collect()] == [1]
    assert store.append(documents(spark, [(2, "b")]), F.lit(0)) == 2
    assert sorted(r.doc_id for r in store.rows().collect()) == [1, 2]


def test_plan_in_parts_keeps_all_rows(spark):
    store = ShardStore(spark, scratch(spark, "store"))
    rows = [(k, "x" * 20, "s") for k in range(200)]
    store.append(documents(spark, rows), F.col("doc_id") % 3, shard_bytes=64, range_bytes=64)
    before = store.manifest().count()
    store.compact(target=1024, fanout=4, tiers=2, plan_runs=10)
    assert content(store.rows()) == sorted(rows, key=str) and store.manifest().count() < before


def test_a_changed_type_is_refused_and_leaves_the_version(spark):
    store = ShardStore(spark, scratch(spark, "store"))
    first = spark.createDataFrame([(1, "a", 7)], "doc_id bigint, text string, extra int")
    store.append(first, F.lit(0))
    for bad in ("doc_id bigint, text string, extra string", "doc_id int, text string", "doc_id bigint, text string, Extra int"):
        with pytest.raises(TypeChange):
            store.append(spark.createDataFrame([], bad), F.lit(0))
    assert store.version() == 1 and store.rows().select("doc_id", "extra").collect() == [(1, 7)]
    store.append(spark.createDataFrame([(2, "b", ["x"])], "doc_id bigint, text string, other array<string>"), F.lit(0))
    store.append(first, F.lit(1))
    store.compact(target=100, fanout=2, tiers=2)
    assert sorted(((r.doc_id, r.extra, r.other) for r in store.rows().collect()), key=str) == [(1, 7, None), (1, 7, None), (2, None, ["x"])]


def test_runs_are_filed_by_the_tiers_in_force(spark):
    store = ShardStore(spark, scratch(spark, "store"))
    docs = documents(spark, [(k, "x" * 50) for k in range(100)])
    store.append(docs, F.lit(0), shard_bytes=100, range_bytes=400)
    assert store.tiers() == Tiers()
    store.compact(target=1000, fanout=4, tiers=3)
    assert store.tiers() == Tiers(1000, 4, 3)
    assert store.append(docs, F.lit(1), shard_bytes=100, range_bytes=400) == 3 and store.tiers() == Tiers(1000, 4, 3)
    floors = [1000 // 4 ** (3 - t) for t in (1, 2, 3)]
    runs = store.manifest().collect()
    assert all(r.tier == sum(r.bytes >= f for f in floors) for r in runs) and any(r.tier == 3 for r in runs)
