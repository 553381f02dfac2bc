import hashlib
import re

import pytest
from helpers import documents
from test_mixing import brute_targets, size
from test_simhash import roots
from test_similar import jaccard, shingle_set

import corpus_pipeline
from threadlens.llm import quality

public_tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_stages_match_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, results = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        results.append((before, docs.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    (all_docs, good), (_, distinct), (_, apart), (_, mix), (_, encoded) = results

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert sum(r.doc_id in kept for r in all_docs if labels.get(r.doc_id) == 1) >= 0.97 * sum(v == 1 for v in labels.values())
    assert sum(r.doc_id in kept for r in all_docs if labels.get(r.doc_id) == 0) <= 0.1 * sum(v == 0 for v in labels.values())

    first = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r)
    assert sorted(first.values()) == sorted(distinct)

    sets = {r.doc_id: shingle_set(r.text) for r in distinct}  # 5 words, Jaccard similarity 0.8 or more
    ids = sorted(sets)
    comp = roots(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(sets[a], sets[b]) >= 0.8 or sets[a] == sets[b]])
    least = {}
    for r in sorted(distinct, key=lambda r: r.doc_id):
        least.setdefault(comp[r.doc_id], r)
    assert sorted(least.values()) == sorted(apart)

    sizes, took, own = {}, {}, {r.doc_id: r for r in apart}
    for r in apart:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in mix:
        took[r.source] = took.get(r.source, 0) + size(r.text)
        assert r.text.split() == own[r.doc_id].text.split()[: size(r.text)]
    for s, target in brute_targets(sizes).items():
        assert abs(took.get(s, 0) - target) <= 1

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in mix:
        ids = own.encode(r.text, add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, encoded)) == sorted(want)


def test_run_gives_the_rows_of_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_stages_take_odd_rows(spark, edge_rows, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (edge_rows, []):
        for _, stage in corpus_pipeline.STAGES:
            docs = documents(spark, rows)
            got = stage(spark, docs, str(tmp_path))
            got.collect()
            assert stage is corpus_pipeline.bpe_encode or got.columns == docs.columns


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = documents(spark, [(k, r.text) for k, r in enumerate(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").join(docs, "doc_id").limit(40).collect())])
    assert quality.accepted(clean, model).count() >= 39
