"""The entry module: its names, and that it works without the corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 90


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).columns == ["site", "tag", "b", "a", "h1", "h2"]


def test_a_few_queries_match_their_sql(spark, sf_dir):
    import duckdb
    import pytest

    if not os.path.isfile(f"{sf_dir}/part.parquet"):
        pytest.skip("tables of another layout")
    db = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name in ("e6_tag_metrics", "d2_comments", "e9_self_answer", "c8_popular", "g4_apply_phrases", "f5_sample", "d10_fused", "e29_patterns", "e36_kappa"):
        df = __spark_entry__.queries()[name](spark, sf_dir)
        columns = sorted(df.columns)
        same = lambda rows: sorted([tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows], key=str)
        got = db.execute(__spark_entry__.oracle_sql()[name])
        at = [[d[0] for d in got.description].index(c) for c in columns]
        assert same(map(tuple, df.select(columns).collect())) == same(tuple(r[k] for k in at) for r in got.fetchall()), name


def test_imports_without_the_corpus_operators(tmp_path):
    shutil.copytree(f"{REPO}/threadlens", f"{tmp_path}/threadlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, files in os.walk(f"{REPO}/threadlens"):
        for f in files:
            if f.endswith(".py") and "/llm" not in folder:
                with open(f"{folder}/{f}", encoding="utf-8") as source:
                    assert "llm" not in source.read(), f
