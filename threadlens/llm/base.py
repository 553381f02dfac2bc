"""Shared pieces: text rules, table reads, and sizes that are checked before use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, scratch, shared_dir  # noqa: F401  for the operators of this subpackage

#: ASCII white space as the contracts define it, in Java regex form.
SPACE = r"[\x20\x09-\x0D]+"
#: A maximal run of anything else: one word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def id_hash_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def matching(left: str, right: str, *columns: str) -> Column:
    """Null-safe equality of the columns of two aliased frames."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return out


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def smallest_by_hash(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest hash of their id, or all if there are fewer.

    In a large input a bound on the hash leaves few more than that before they
    are ordered, so that no task sends the driver more than its share.
    """
    h = F.shiftrightunsigned(F.xxhash64(id_col), 1)
    n = df.count()
    if n > 2 * rows + 2000:
        df = df.where(h < F.lit(int((1.2 * rows + 1000) / n * 2**63)))
    return df.orderBy(h, id_col).limit(rows)


#: Rows up to which a table of short rows is broadcast.
SMALL_ROWS = 100_000


def small_side(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small, else as it is.

    For metadata that usually is small whatever the planner thinks of it; the
    count is cheap where ``df`` has been cut.
    """
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


#: Rows of short tables that a part is worth, and parts that are kept however few rows there are.
PART_ROWS, PARTS = 4096, 8


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of short rows, ``rows`` of them at most, in no more parts than they are worth.

    Each task of a step leaves files of its shuffle and a record in the event
    log, whatever it read, so steps on small tables cost by the parts they read.
    """
    return df.coalesce(max(PARTS, -(-rows // PART_ROWS)))


def cut_packed(df: DataFrame) -> DataFrame:
    """``df`` of short rows, cut, counted, and read in no more parts than its rows are worth."""
    df = cut(df)
    return packed(df, df.count())


#: Rows with whole texts that go to Python at a time, and their bytes, at most (one row may have more).
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` for a Python function over whole texts.

    Lowers the session's batch limits, if they are larger, so that neither the
    JVM nor Python holds thousands of long texts at once.  Spark reads these
    settings when a plan runs, so they can't be set for one plan alone.
    """
    conf, rows, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if conf.get(size) in ("-1b", "67108864b", "64MB"):  # not where a user has chosen a size
        conf.set(size, str(BATCH_BYTES))
    return df
