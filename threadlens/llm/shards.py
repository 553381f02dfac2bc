"""Sharding by size-tiered compaction (DataFrame functions only on the data path).

A store is a folder below the shared folder:

    data/operation=<operation>/run=<name>/part-*.parquet   immutable files
    manifest/<operation>/                                  one row for each live run
    commits/v<number>                                      names a version's manifest, its rows' schema, and the tiers its runs are filed by

``append`` writes arrivals as small shards.  ``compact`` merges FANOUT runs of
one size tier at a time, tier after tier, until the runs have the target size;
the whole plan is made on the manifest, so each row is rewritten once.  A run's
name begins with the version that brought it, so equal arrival numbers of two
appends never share a name; rows are read by operation and run.

A version exists from the moment its commit file has its final name: the file
is written whole under another name and then renamed, which fails if another
writer took that version first.  A writer that dies leaves no version behind,
only files that no version names.  Readers see one version, whole.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .base import cut, free_name, small_side, text_of

#: Bytes of text in a small shard, about; runs of at least TARGET_BYTES are final.
SHARD_BYTES = 8 << 20
TARGET_BYTES = 64 << 20
#: Runs merged at once; the smallest run of tier t + 1 is FANOUT times that of tier t.
FANOUT = 4
TIERS = 5
#: Arrivals in one pass over the ids (a batch is cut into hash ranges of about this many bytes).
RANGE_BYTES = SHARD_BYTES
#: Runs that one task of the plan orders, about; tasks that one compaction writes with, at most.
PLAN_RUNS = 50_000
WRITE_TASKS = 100_000

_FILES = {"compression": "zstd"}


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class TypeChange(ValueError):
    """Rows to append have a column that the store keeps with another type."""


class Tiers(NamedTuple):
    """How runs are filed: the size of final runs, runs merged at once, tiers below the final one."""

    target: int = TARGET_BYTES
    fanout: int = FANOUT
    tiers: int = TIERS


def tier(size: Column, target: int = TARGET_BYTES, fanout: int = FANOUT, tiers: int = TIERS) -> Column:
    """0 for the smallest runs, ``tiers`` for those of target size and more."""
    steps = [(size >= F.lit(target // fanout ** (tiers - t))).cast("int") for t in range(1, tiers + 1)]
    return reduce(lambda a, b: a + b, steps)



class ShardStore:
    """A versioned store of (doc_id, text, ...) rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest committed version; 0 for an empty store."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """run, operation, arrival, tier, rows, bytes of the version's live runs."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], "run string, operation string, arrival int, tier int, rows bigint, bytes bigint")
        return self.spark.read.parquet(f"{self.root}/manifest/{self._named(version)[0]}")

    def _named(self, version: int) -> tuple[str, StructType]:
        """(operation, schema) of a version."""
        operation, schema, *_ = self._commit_lines(version)
        return operation, StructType.fromJson(json.loads(schema))

    def tiers(self, version: int | None = None) -> Tiers:
        """The tiers by which a version's runs are filed: those of the last compaction, at first the default ones."""
        version = self.version() if version is None else version
        lines = self._commit_lines(version) if version else []
        return Tiers(*json.loads(lines[2])) if len(lines) > 2 else Tiers()

    def _commit_lines(self, version: int) -> list[str]:
        named = self._fs.open(self._path(f"{self.root}/commits/v{version}"))
        try:
            return bytes(named.readAllBytes()).decode().split("\n")
        finally:
            named.close()

    def _commit(self, manifest: DataFrame, operation: str, version: int, schema: StructType, tiers: Tiers = Tiers()) -> None:
        manifest.write.parquet(f"{self.root}/manifest/{operation}")
        jvm, draft = self.spark._jvm, self._path(f"{self.root}/commits/.{operation}")
        out = self._fs.create(draft, False)
        out.write(bytearray(f"{operation}\n{schema.json()}\n{json.dumps(tiers)}".encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path(f"{self.root}/commits/v{version}")), no_options)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise Conflict(f"version {version} is taken") from e
            raise

    def _read(self, operations: list[str], schema: StructType) -> DataFrame:
        """All rows that the operations wrote, with operation and run; columns that an old shard lacks are null."""
        full = StructType([*schema.fields, StructField("operation", StringType())])
        return self.spark.read.schema(full).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/data/operation={o}" for o in operations])

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with their run; columns that an old shard lacks are null.  Not for version 0."""
        version = self.version() if version is None else version
        schema = self._named(version)[1]
        live = self.manifest(version).select("operation", "run")
        operations = [r[0] for r in live.select("operation").distinct().sort("operation").collect()]  # one for each append and compaction
        if not operations:
            return self.spark.createDataFrame([], schema)
        return self._read(operations, schema).join(small_side(live), ["operation", "run"], "left_semi").select(schema.names)

    def append(self, docs: DataFrame, arrival: Column, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> int:
        """Writes each arrival as small shards and commits them; returns the version.

        An arrival is cut into hash ranges of the id, and a range, in hash
        order, into shards wherever its running size passes ``shard_bytes``.
        Every shard is made by one task and is one file.  Null texts count no
        bytes; null and repeated ids and repeated rows stay; an empty input
        commits a version without new runs.  Columns named arrival, operation
        or run are replaced by the store's own.  A column that the store has with
        another type, or in other capitals, is refused before anything is written.
        """
        base, operation = self.version(), f"append-{uuid.uuid4().hex}"
        have = {f.name.lower(): f for f in self._named(base)[1].fields} if base else {}
        changed = [f"{f.name} {f.dataType.simpleString()} is kept as {was.name} {was.dataType.simpleString()}" for f in docs.schema if f.name.lower() not in ("arrival", "operation", "run") and (was := have.get(f.name.lower())) and (was.name, was.dataType.simpleString()) != (f.name, f.dataType.simpleString())]
        if changed:
            raise TypeChange("; ".join(changed))
        kept = [c for c in docs.columns if c.lower() not in ("arrival", "operation", "run")]  # the names of the store's own are replaced
        size, order, span, spans = (free_name(docs, n) for n in ("_size", "_order", "_range", "_ranges"))
        digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
        rows = docs.withColumns({"arrival": F.coalesce(arrival, F.lit(0)).cast("int"), size: F.octet_length(text_of()).cast("long"), order: digest})
        sizes = cut(rows.groupBy("arrival").agg(F.ceil((F.sum(size) + 1) / F.lit(range_bytes)).cast("long").alias(spans)))
        # One row an arrival; joined by a shuffle, all rows of an arrival would meet in one task.
        rows = rows.join(small_side(sizes), "arrival")
        rows = rows.withColumn(span, F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * F.col(spans) / F.lit(float(1 << 32))).cast("long"))
        before = Window.partitionBy("arrival", span).orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        piece = F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / shard_bytes).cast("long")
        rows = rows.withColumn("run", F.format_string("v%06d-a%05d-r%07d-p%05d", F.lit(base + 1), "arrival", span, piece)).select(*kept, "arrival", "run")
        rows.write.options(**_FILES).partitionBy("run").parquet(f"{self.root}/data/operation={operation}")
        schema = StructType(rows.schema.fields)
        if base:
            schema = StructType([*schema.fields, *[f for f in self._named(base)[1].fields if f.name not in schema.names]])
        filed = self.tiers(base)
        new = self._measured(operation, schema, filed).withColumn("arrival", F.regexp_extract("run", r"^v\d+-a(-?\d+)-r", 1).cast("int"))
        self._commit(self._columns(self.manifest(base).unionByName(self._columns(new))), operation, base + 1, schema, filed)
        return base + 1

    def _measured(self, operation: str, schema: StructType, filed: Tiers) -> DataFrame:
        out = self._read([operation], schema).groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text_of())).cast("long").alias("bytes"))
        return out.withColumn("operation", F.lit(operation)).withColumn("tier", tier(F.col("bytes"), *filed))

    @staticmethod
    def _columns(manifest: DataFrame) -> DataFrame:
        return manifest.select("run", "operation", "arrival", "tier", "rows", "bytes")

    def plan(self, version: int | None = None, target: int = TARGET_BYTES, fanout: int = FANOUT, tiers: int = TIERS, plan_runs: int = PLAN_RUNS) -> DataFrame:
        """run, into, bytes: which run each live run ends up in.

        Tier by tier, the runs of a tier in name order are taken ``fanout`` at
        a time; a full handful becomes one run, named after its first member,
        which may be merged again in the next tier.  Works on one row a run;
        for every ``plan_runs`` of them the runs are dealt by hash to one more
        part, each planned by itself.
        """
        plan = self.manifest(version).select("run", "bytes", F.col("run").alias("into"))
        parts = -(-plan.count() // plan_runs) or 1
        part = F.pmod(F.xxhash64("into"), F.lit(parts)) if parts > 1 else F.lit(0).cast("long")
        plan = plan.withColumn("part", part)
        for t in range(tiers):
            by = Window.partitionBy("part").orderBy("into")
            runs = plan.groupBy("part", "into").agg(F.sum("bytes").alias("bytes")).where(tier(F.col("bytes"), target, fanout, tiers) == t)
            runs = runs.withColumn("hand", F.floor((F.row_number().over(by) - 1) / fanout))
            hand = Window.partitionBy("part", "hand")
            runs = runs.withColumns({"merged": F.min("into").over(hand), "full": F.count(F.lit(1)).over(hand) == fanout}).where("full").select("into", "merged")
            plan = cut(plan.join(runs, "into", "left").select("run", "bytes", "part", F.coalesce("merged", "into").alias("into")))
        return plan.select("run", "into", "bytes")

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT, tiers: int = TIERS, plan_runs: int = PLAN_RUNS) -> int:
        """Merges runs by the plan and commits; returns the version (unchanged if nothing merges).

        Each new run is written by one task, which reads less than ``fanout``
        times the target, whatever the number of shuffle partitions.
        """
        base, operation = self.version(), f"merge-{uuid.uuid4().hex}"
        if base == 0:
            return 0
        manifest, plan = self.manifest(base), self.plan(base, target, fanout, tiers, plan_runs)
        heads = plan.groupBy("into").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        # One row a new run; a hash of the name deals them to tasks only beyond WRITE_TASKS.
        new_runs = heads.count()
        if new_runs == 0:
            return base
        if new_runs <= WRITE_TASKS:
            heads = heads.withColumn("task", (F.row_number().over(Window.orderBy("into")) - 1).cast("int"))
        else:
            heads = heads.withColumn("task", F.pmod(F.xxhash64("into"), F.lit(WRITE_TASKS)).cast("int"))
        moved = cut(plan.join(heads.drop("members"), "into").select("run", "into", "task"))
        task = free_name(self.rows(base), "_task")
        rows = self.rows(base).join(small_side(moved.withColumnRenamed("task", task)), "run").drop("run").withColumnRenamed("into", "run")
        rows = rows.repartitionById(min(new_runs, WRITE_TASKS), F.col(task)).drop(task)
        rows.write.options(**_FILES).partitionBy("run").parquet(f"{self.root}/data/operation={operation}")
        schema = self._named(base)[1]
        filed = Tiers(target, fanout, tiers)
        new = self._measured(operation, schema, filed).withColumn("arrival", F.lit(None).cast("int"))
        kept = manifest.join(moved.select("run"), "run", "left_anti").withColumn("tier", tier(F.col("bytes"), *filed))
        self._commit(self._columns(kept).unionByName(self._columns(new)), operation, base + 1, schema, filed)
        return base + 1

    def vacuum(self) -> None:
        """Deletes the folders of operations that the latest version no longer names.

        Not for use while other writers, or readers of older versions, are at work.
        """
        live = {r[0] for r in self.manifest().select("operation").distinct().collect()}
        folder = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(folder):
            if s.getPath().getName().removeprefix("operation=") not in live:
                self._fs.delete(s.getPath(), True)


def layout(store: ShardStore, version: int | None = None) -> DataFrame:
    """doc_id, n_bytes, arrival, run, tier, run_rows, run_bytes for each row of a version."""
    manifest = store.manifest(version).select("run", "tier", F.col("rows").alias("run_rows"), F.col("bytes").alias("run_bytes"))
    rows = store.rows(version).select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), "arrival", "run")
    return rows.join(small_side(manifest), "run").select("doc_id", "n_bytes", "arrival", "run", "tier", "run_rows", "run_bytes")
