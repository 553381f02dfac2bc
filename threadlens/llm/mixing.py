"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

1. Word counts are summed by source; the sources in code-point order weigh
   3, 1, 2, repeating, and share a budget of 150 % of all words.  No target
   passes twice its source's size: the excess is shared out again by weight.
2. Each source's documents stand in a fixed shuffled order (by hash of the id);
   running sums cut that token stream into blocks of equal token count.
3. A source needs a certain number of blocks (slots), wrapping round to the
   start of its stream when it is used up.  All slots lie along one axis in
   proportion to the cumulative slot counts.  Slot i of the schedule is the van
   der Corput point of i (its bits reversed), mapped through those cumulative
   weights, so any stretch of the schedule holds each source nearly in
   proportion, and the whole schedule holds exactly the wanted counts.
4. The slots of a source, ranked by schedule position, take its blocks in
   order; joining them to the pieces of documents inside each block gives the
   words taken from each document, and the slots at which it comes up.

``mix`` tells the slots and ``mixed`` puts its rows in their order, so that any
stretch of the output holds the sources nearly at their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import WORD, cut, free_name, is_empty, matching, small_side, text_of

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words.
BUDGET = 1.5
#: Most times a source may be passed through.
MAX_EPOCHS = 2
#: Words in a block.
BLOCK_WORDS = 1024
#: Rows that a chunk of the shuffled order should hold.
CHUNK_ROWS = 8192
#: Slots that one task of mixed() puts in order, about, and tasks at most.
TASK_SLOTS, TASKS = 4096, 100_000


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> source, source_size, weight, target (double).

    One row a source goes in, so the windows here see as many rows as there
    are sources.  Sources ordered by size/weight reach their cap in that order:
    with the capped ones removed, the rest share what is left by weight.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    out = out.withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.partitionBy()
    out = out.withColumn("total", F.lit(budget) * F.sum("source_size").over(everything))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = out.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / F.sum("weight").over(onward))
    out = out.withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    # The first uncapped source sees exactly what the uncapped ones share.
    out = out.withColumn("share", F.max(F.when(~F.col("capped"), F.struct(-F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("share") * F.col("weight"))
    return out.select("source", "source_size", "weight", target.alias("target"))


def _positions(sized: DataFrame, rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Adds start: words of the same source that stand before the document.

    The order is by a hash of the id; ``rows`` (skey, n_rows) says into how
    many hash ranges each source is cut.  A first pass sums words by range, a
    second runs over those sums, and a third runs inside each range.  No task
    sees a whole source.
    """
    sized = sized.join(small_side(rows.select("skey", F.ceil(F.col("n_rows") / F.lit(chunk_rows)).cast("long").alias("chunks"))), "skey")
    sized = sized.withColumn("chunk", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("chunks") / F.lit(float(1 << 32))).cast("long")).drop("chunks")
    sums = sized.groupBy("skey", "chunk").agg(F.sum("size").alias("words"))
    # Ranges of one source: its rows over CHUNK_ROWS, however large the source.
    before = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words"))
    inside = Window.partitionBy("skey", "chunk").orderBy("order", "uid").rowsBetween(Window.unboundedPreceding, -1)
    return sized.join(sums, ["skey", "chunk"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def source_key() -> Column:
    """Never null, so that joins find it: a null source is a source of its own."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def axis_bits(slots: int) -> int:
    """Bits of the schedule's numbers for so many slots."""
    return max(1, (int(slots) - 1).bit_length())


def schedule(spark: SparkSession, plan: DataFrame, block_words: int) -> DataFrame:
    """The slots of the mix: skey, slot, rank, block, words.

    ``plan``: skey, source_size, goal (whole words wanted), one row a source.
    The axis is cut at the cumulative slot counts; position v of the axis is
    drawn at schedule slot reverse_bits(v), which is the van der Corput order
    with the points beyond the axis left out.
    """
    plan = plan.where("goal > 0").withColumn("per_epoch", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    whole, rest = F.floor(F.col("goal") / F.col("source_size")).cast("long"), F.col("goal") % F.col("source_size")
    plan = plan.withColumn("slots", whole * F.col("per_epoch") + F.ceil(rest / F.lit(block_words)).cast("long"))
    along = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)
    plan = cut(plan.withColumn("low", F.coalesce(F.sum("slots").over(along), F.lit(0)).cast("long")))
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = axis_bits(total)
    # Every source makes its own stretch of the axis, 4096 positions a row first, so that one large source is dealt out.
    strides = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / 4096).cast("long"))).alias("stride"))
    axis = strides.repartition(F.col("skey"), F.col("stride")).select(
        "skey", "source_size", "goal", "per_epoch",
        F.explode(F.sequence(F.col("low") + F.col("stride") * 4096, F.least(F.col("low") + F.col("slots"), F.col("low") + (F.col("stride") + 1) * 4096) - 1)).alias("v"),
    )
    slot = F.conv(F.reverse(F.lpad(F.bin("v"), bits, "0")), 2, 10).cast("long")
    axis = axis.withColumn("slot", slot).withColumn("era", F.floor(F.col("slot") / 65536).cast("long"))
    sums = axis.groupBy("skey", "era").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("skey").orderBy("era").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("skey", "era").orderBy("slot")
    ranked = axis.join(sums.hint("merge"), ["skey", "era"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    ranked = ranked.withColumn("block", F.col("rank") % F.col("per_epoch")).withColumn("epoch", F.floor(F.col("rank") / F.col("per_epoch")).cast("long"))
    at = F.col("block") * block_words
    words = F.least(F.lit(block_words), F.col("source_size") - at, F.col("goal") - F.col("epoch") * F.col("source_size") - at)
    return ranked.select("skey", "slot", "rank", "epoch", "block", words.cast("long").alias("words"))


def placed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = 42, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(documents with uid, doc_id, skey, size, start; the plan of the sources)."""
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = cut(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", source_key().alias("skey"), size.alias("size"), order.alias("order")))
    sizes = cut(sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")))
    plan = targets(sizes.select("source", "source_size"), weights, budget, max_epochs)
    plan = cut(plan.withColumn("skey", source_key()).withColumn("goal", F.round("target").cast("long")))
    return _positions(sized, sizes, chunk_rows), plan


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, seed: int = 42, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row for each document: uid, doc_id, skey, size, source_size, target, taken, epochs, slots.

    ``taken`` counts the words that the mix takes from the document, repeats
    included; ``epochs`` lists the words taken in each pass, which are the
    first so many words of the text, and ``slots`` the schedule's slot at which
    each pass reaches it.  Null text has size 0 and is never taken; a null
    source is one source, last in order; null or repeated ids are ordered among
    themselves by row.  Empty input gives an empty result.
    """
    docs_at, plan = placed(docs, weights, budget, max_epochs, seed, chunk_rows)
    slots = schedule(docs.sparkSession, plan.select("skey", "source_size", "goal"), block_words)
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    docs_at = cut(docs_at.select("uid", "doc_id", "skey", "size", "start"))
    pieces = docs_at.where("size > 0").select("uid", "skey", "start", "size", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("block"))
    low = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words), F.col("words"))
    took = pieces.join(slots.hint("merge"), ["skey", "block"]).select("uid", "epoch", "slot", (high - low).alias("took")).where("took > 0")
    took = took.groupBy("uid", "epoch").agg(F.sum("took").alias("took"), F.min("slot").alias("slot"))
    passes = F.array_sort(F.collect_list(F.struct("epoch", "took", "slot")))  # one a pass, MAX_EPOCHS at most
    took = took.groupBy("uid").agg(F.sum("took").alias("taken"), passes.alias("passes"))
    empty = F.array().cast("array<bigint>")
    return (
        docs_at.join(took.hint("merge"), "uid", "left")
        .join(small_side(plan.select("skey", "source_size", "target")), "skey")
        .select(
            "uid", "doc_id", "skey", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
            F.coalesce(F.col("passes.took"), empty).alias("epochs"), F.coalesce(F.col("passes.slot"), empty).alias("slots"),
        )
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, once for each pass that takes words from them, in the schedule's order.

    All columns stay.  A document of which a pass takes only the first words
    has those words, joined by single spaces, as its text there, and n_chars,
    if there is such a column, follows.  Rows that share id, source and size
    are interchangeable: they take each other's shares in order of their text.
    The partitions follow each other along the schedule, and slots hold equal
    numbers of words, so partitions do too.
    """
    told = cut(mix(docs, **options).select("doc_id", "skey", "uid", "size", "epochs", "slots"))
    names = {c: free_name(docs, c) for c in ("_size", "_epochs", "_slots", "_copy", "_skey", "_pass", "_task")}
    size, epochs, slots, copy, skey, turn, task = names.values()
    rows = docs.withColumn(size, F.regexp_count(text_of(), F.lit(WORD)).cast("long"))
    took = told.withColumnsRenamed({"size": size, "epochs": epochs, "slots": slots, "skey": skey})
    keys = ["doc_id"]
    if not is_empty(told.groupBy("doc_id").count().where("count > 1")):
        keys = ["doc_id", skey, size, copy]
        alike = Window.partitionBy("doc_id", skey, size)
        rows = rows.withColumn(skey, source_key()).withColumn(copy, F.row_number().over(alike.orderBy("text")))
        took = took.withColumn(copy, F.row_number().over(alike.orderBy(slots, epochs, "uid")))
    passes = F.arrays_zip(F.col(epochs).alias("words"), F.col(slots).alias("slot"))
    took = took.where(F.size(epochs) > 0).select(*keys, passes.alias(turn))
    rows = rows.alias("d").join(took.alias("k").hint("merge"), matching("d", "k", *keys)).select("d.*", f"k.`{turn}`")
    rows = rows.withColumn(turn, F.explode(turn))
    words = F.col(f"{turn}.words")
    whole = words == F.col(size)
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    out = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(first))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    last = told.agg(F.max(F.array_max("slots"))).first()[0] or 0
    tasks = min(TASKS, last // TASK_SLOTS + 1)
    out = out.withColumn(task, F.floor(F.col(f"{turn}.slot") * tasks / F.lit(last + 1)).cast("int"))
    return out.repartitionById(tasks, F.col(task)).sortWithinPartitions(f"{turn}.slot", "doc_id").select(docs.columns)
