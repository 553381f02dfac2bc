"""The thin ``opN_<name>`` queries and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, negatives, pii, quality, simhash, spelling, toxicity
from .base import scratch, table
from .bpe import encode_documents
from .exact_dedup import dedup
from .html_text import extract_pages
from .licenses import license_scan
from .mixing import mix
from .shards import FANOUT, SHARD_BYTES, TARGET_BYTES, TIERS, ShardStore, layout


def corpus_path() -> Column:
    """A repository path for a document: source/outer/inner/name, from its source and the hash of its id.

    Every tenth document is a licence file; it lies in the source's folder, an
    outer or an inner one in turn.
    """
    spread = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    outer, inner = (spread % 64).cast("string"), (F.floor(spread / 64) % 16).cast("string")
    is_license, turn = F.col("doc_id") % 10 == 0, F.floor(F.col("doc_id") / 10) % 3
    folder = F.when(is_license & (turn == 0), source).when(is_license & (turn == 1), F.concat_ws("/", source, outer)).otherwise(F.concat_ws("/", source, outer, inner))
    return F.concat(folder, F.when(is_license, F.lit("/LICENSE-")).otherwise(F.lit("/file-")), F.col("doc_id").cast("string"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), corpus_path().alias("path"), "text")
    return license_scan(files).withColumnRenamed("file_id", "doc_id")


def op2_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in two appends of four arrivals each (0 to 3 both times), by hash of the id; the result is the layout after compaction."""
    store = ShardStore(spark, scratch(spark, "shards"))
    docs = table(spark, sf_dir, "documents")
    turn = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 9, 1), 16, 10).cast("int")
    for part in (turn < 8, F.coalesce(turn >= 8, F.lit(True))):
        store.append(docs.where(part), turn % 4)
    store.compact()
    store.vacuum()
    return layout(store)


def op3_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("slots", F.lit(1)).alias("first_slot"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id counts as of the next label, so that labels are noisy."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label_col=label)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), planted=spelling.PLANTED)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ``base_sha256`` are of the base spans; ``spans`` has those that deobfuscation adds, too, and ``n_added`` their number."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.withColumn("base", base).select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), added)


def _compaction_sql() -> str:
    floors = [TARGET_BYTES // FANOUT ** (TIERS - t) for t in range(1, TIERS + 1)]
    tier = lambda size: "(" + " + ".join(f"CAST({size} >= {f} AS INT)" for f in floors) + ")"
    sql = f"""
        WITH e AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, md5(CAST(doc_id AS VARCHAR)) AS pos,
                          CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 9, 1) AS BIGINT) AS INT) AS turn FROM documents),
        d AS (SELECT doc_id, n_bytes, pos, turn % 4 AS arrival, 1 + turn // 8 AS version FROM e),
        a AS (SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY version, arrival) AS BIGINT) AS total FROM d),
        r AS (SELECT *, CAST(floor(CAST('0x' || substr(pos, 1, 8) AS BIGINT) * ceil((total + 1) / {SHARD_BYTES}) / 4294967296.0) AS BIGINT) AS rng FROM a),
        p AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY version, arrival, rng ORDER BY pos, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {SHARD_BYTES} AS piece FROM r),
        s AS (SELECT *, format('v{{:06d}}-a{{:05d}}-r{{:07d}}-p{{:05d}}', version, arrival, rng, CAST(piece AS BIGINT)) AS run FROM p),
        m0 AS (SELECT run, run AS dest, sum(n_bytes) AS bytes FROM s GROUP BY run)"""
    for t in range(TIERS):
        sql += f""",
        g{t} AS (SELECT dest, (row_number() OVER (ORDER BY dest) - 1) // {FANOUT} AS hand FROM (SELECT dest, sum(bytes) AS bytes FROM m{t} GROUP BY dest) WHERE {tier("bytes")} = {t}),
        h{t} AS (SELECT dest, min(dest) OVER (PARTITION BY hand) AS merged, count(*) OVER (PARTITION BY hand) AS n FROM g{t}),
        m{t + 1} AS (SELECT run, bytes, coalesce(merged, m.dest) AS dest FROM m{t} m LEFT JOIN (SELECT * FROM h{t} WHERE n = {FANOUT}) h ON m.dest = h.dest)"""
    sql += f""",
        f AS (SELECT s.doc_id, s.n_bytes, s.arrival, m.dest AS run FROM s JOIN m{TIERS} m USING (run)),
        z AS (SELECT run, count(*) AS run_rows, CAST(sum(n_bytes) AS BIGINT) AS run_bytes FROM f GROUP BY run)
        SELECT doc_id, n_bytes, arrival, run, {tier("run_bytes")} AS tier, run_rows, run_bytes FROM f JOIN z USING (run)"""
    return sql


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_tiered_compaction": op2_tiered_compaction,
    "op3_multi_index_hashing": op3_multi_index_hashing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_html_blocks": op5_html_blocks,
    "op6_simhash_pivots": op6_simhash_pivots,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_source_mix": op9_source_mix,
    "op10_bpe": op10_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_pii": op13_pii,
}

ORACLES = {
    "op2_tiered_compaction": _compaction_sql(),
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, text_sha256 FROM n""",
    "op9_source_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          md5('42:' || CAST(doc_id AS VARCHAR)) AS pos FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS cap FROM s),
        l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
                        / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM w),
        c AS (SELECT *, level * weight >= cap AS capped FROM l),
        g AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT arg_min(level, cap / weight) FROM c WHERE NOT capped) END AS target FROM c),
        p AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, round(g.target) AS goal,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.pos, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
              FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
        k AS (SELECT p.*, CAST(least(size, greatest(0, goal - start)) + least(size, greatest(0, goal - source_size - start)) AS BIGINT) AS taken FROM p),
        b AS (SELECT source, CAST(round(target) AS BIGINT) AS goal, source_size FROM g WHERE round(target) > 0),
        n AS (SELECT source, goal // source_size * CAST(ceil(source_size / 1024) AS BIGINT) + CAST(ceil(goal % source_size / 1024) AS BIGINT) AS slots FROM b),
        o AS (SELECT source, slots, CAST(coalesce(sum(slots) OVER (ORDER BY source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low,
                     greatest(1, length(ltrim(bin(CAST(sum(slots) OVER () AS BIGINT) - 1), '0'))) AS bits FROM n),
        u AS (SELECT source, bits, low, unnest(range(CAST(slots AS BIGINT))) AS k FROM o),
        v AS (SELECT source, CAST('0b' || reverse(lpad(bin(low + k), CAST(bits AS INT), '0')) AS BIGINT) AS slot FROM u),
        t AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM v)
        SELECT doc_id, size, k.source_size, target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot
        FROM k LEFT JOIN t ON k.source IS NOT DISTINCT FROM t.source AND k.start // 1024 = t.rank""",
    "op11_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
              FROM r a JOIN r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
              FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT * FROM n WHERE rank <= 3""",
}
