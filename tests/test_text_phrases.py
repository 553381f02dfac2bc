import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadlens import lineage
from threadlens.functions import technology, text
from threadlens.operators import phrases


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("a ```b\nc``` d", "a d"), ("a `b` c", "a c"), ("<p>a<code>b</code>c<pre>d</pre></p>", "a c"), ("x<script>1<2</script>y<style>p{}</style>z", "x y z"),
        ("<a href='u'>link</a> text<img src=x>", "link text"), ('f <span class="math-container">$x<span>y</span>$</span> g', "f g"), ("<b>a <i>b</i></b> &amp; &lt;c&gt;", "a b & <c>"), ("<p>one</p>\n\n<p>two</p>", "one two"),
    ],
)
def test_html(spark, html, want):
    assert text.html_to_prose(html) == want
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(text.html_text("h")).first()[0] == want


def test_plain_text(spark):
    df = spark.createDataFrame([("<p>a <code>x</code>`y` b</p><!-- no --> &lt;c&gt; ```z\nz```",), (None,)], "h string")
    assert [r[0] for r in df.select(text.plain_text(F.col("h"))).collect()] == ["a b <c>", ""]


def test_tokens(spark):
    df = spark.createDataFrame([("The foo-bar foo_bar 42 x keys, Cities! question -- don't",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.tokens(F.col("t"))).collect()]
    assert got == [["foo-bar", "foo_bar", "key", "city", "dont"], [], None]
    assert df.select(text.strip_punctuation(F.lit("a.b_c-d!"))).first()[0] == "ab_c-d"
    kept = df.select(text.without_stopwords(F.array(F.lit("a"), F.lit("b"), F.lit("a")), {"b"})).first()[0]
    assert kept == ["a", "a"]


def test_stop_words_are_looked_up_in_a_set(spark):
    df = spark.createDataFrame([(["the", "key", "the", "of", None, "key"],), ([],), (None,)], "w array<string>")
    out = df.select(text.without_stopwords(F.col("w"), text.stopwords()))
    assert [r[0] for r in out.collect()] == [["key", "key"], [], None]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan
    assert df.select(text.without_stopwords(F.col("w"), set())).first()[0] == ["the", "key", "the", "of", None, "key"]


def test_split_tokens(spark):
    df = spark.createDataFrame([("a  b",), ("['x', 'y z']",), ('["q"]',), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.split_tokens(F.col("t"))).collect()] == [["a", "b"], ["x", "y z"], ["q"], [], []]


def greedy(tokens, table):
    out, k = [], 0
    while k < len(tokens):
        if k + 1 < len(tokens) and (tokens[k], tokens[k + 1]) in table:
            out.append(f"{tokens[k]}_{tokens[k + 1]}")
            k += 2
        else:
            out.append(tokens[k])
            k += 1
    return out


def test_apply_phrases(spark, monkeypatch):
    table = {("a", "b"), ("b", "a"), ("c", "c")}
    docs = [list("abab"), list("aab"), list("cccc"), list("ccc"), ["x"], [], list("bcab"), list("abxba"), None]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, tokens array<string>")
    for most in (phrases.BROADCAST_PHRASES, 0):  # sent to the tasks, or joined
        monkeypatch.setattr(phrases, "BROADCAST_PHRASES", most)
        got = phrases.apply_phrases(df, spark.createDataFrame(sorted(table), "a string, b string"), "i").collect()
        assert {r.i: r.tokens for r in got} == {k: d if d is None else greedy(d, table) for k, d in enumerate(docs)}


def test_many_phrases_are_joined_without_a_shuffle(spark):
    rows = spark.range(300_000).select(F.concat(F.lit("w"), F.col("id") % 1000).alias("a"), F.concat(F.lit("x"), F.col("id") / 1000).cast("string").alias("b"))
    rows = rows.unionByName(spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string"))
    df = spark.createDataFrame([(1, list("abab")), (2, list("cab")), (3, None), (4, ["a"]), (5, ["b", "w5"])], "i int, tokens array<string>")
    got = phrases.apply_phrases(df, rows, "i")
    assert {r.i: r.tokens for r in got.collect()} == {1: ["a_b", "a_b"], 2: ["c", "a_b"], 3: None, 4: ["a"], 5: ["b", "w5"]}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_phrases_match_brute_force():
    rng = random.Random(7)
    table = {(rng.choice("abcde"), rng.choice("abcde")) for _ in range(9)}
    own = phrases.Phrases.of(pa.table({"a": [a for a, _ in table], "b": [b for _, b in table]}))
    texts = [None if rng.random() < 0.1 else [rng.choice("abcdefg") for _ in range(rng.randrange(12))] for _ in range(1300)]
    given = pa.array(texts, pa.list_(pa.string()))
    assert own.join(given).to_pylist() == [t if t is None else greedy(t, table) for t in texts]
    assert own.join(given.slice(7, 20)).to_pylist() == [t if t is None else greedy(t, table) for t in texts[7:27]]
    assert own.join(given.slice(0, 0)).to_pylist() == []


def test_joining_builds_no_table_of_the_phrases(monkeypatch):
    """Each portion of texts searches the phrases; to build a table of all their words for it takes longer the more there are."""
    own = phrases.Phrases.of(pa.table({"a": ["a", "é", "long" * 9, "b"], "b": ["b", "a", "b", "long" * 9]}))
    monkeypatch.setattr(phrases.pc, "index_in", lambda *a, **k: 1 / 0)
    assert own.join(pa.array([["a", "b", "x"], ["é", "a", "b"], ["long" * 9, "b", None, "a"], None, ["long" * 10, "b"]])).to_pylist() == [["a_b", "x"], ["é_a", "b"], ["long" * 9 + "_b", None, "a"], None, ["long" * 10, "b"]]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    real = phrases.word_hashes
    monkeypatch.setattr(phrases, "word_hashes", lambda words, seed, longest=None: real(words, seed, longest) >> np.uint64(64 - 8 * seed) if seed else real(words, 0, 0))
    texts = [["w1", "w2", "w3"], ["v77", "w2", "w1"]]
    own = phrases.Phrases.of(pa.table({"a": [f"w{k}" for k in range(40)], "b": [f"w{k + 1}" for k in range(40)]}))
    assert own.seed > 0 and own.join(pa.array(texts)).to_pylist() == [["w1_w2", "w3"], ["v77", "w2", "w1"]]
    strange = pa.array([f"v{k}" for k in range(3000)])  # some share a hash with a word of the table
    assert (own.places(strange) == -1).all() and sorted(own.places(own.words)) == list(range(41))


def test_uses_of_a_table_of_counts_share_its_exchange(spark):
    df = spark.createDataFrame([(k, ["new", "york", "car"]) for k in range(9)], "i int, tokens array<string>")
    got = phrases.phrase_scores(df)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.partition("== Initial Plan ==")[0].count("Reused") >= 2


def test_passes_keep_one_stage(spark):
    df = spark.createDataFrame([(k, ["new", "york", "car"]) for k in range(30)] + [(99, None)], "i int, tokens array<string>")
    before = set(os.listdir(lineage.shared_dir(spark).removeprefix("file:")))
    got = phrases.with_phrases(df, "i", min_count=1, threshold=0.01)
    assert {tuple(r.tokens or ()) for r in got.collect()} == {("new_york_car",), ()}
    assert len([f for f in set(os.listdir(lineage.shared_dir(spark).removeprefix("file:"))) - before if f.startswith("phrases")]) == 1


def test_scores(spark):
    docs = [["new", "york"]] * 8 + [["new", "car"]] * 5 + [["old", "york"]] + [[w] for w in "pqrst"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, tokens array<string>")
    got = {(r.a, r.b): (r.n, r.score) for r in phrases.phrase_scores(df).collect()}
    # Nine words and three pairs; a pair at the least count scores 0 and is left out.
    assert got == {("new", "york"): (8, (8 - 5) / (13 * 9) * 12)}
    score = got["new", "york"][1]
    assert phrases.mine_phrases(df, threshold=score).collect() == []
    assert len(phrases.mine_phrases(df, threshold=score - 1e-9).collect()) == 1


def test_second_pass_makes_trigrams(spark):
    docs = [["a", "b", "c"]] * 20 + [[w] for w in "defghijklmnopqrstuvwxyz"] * 20
    df = spark.createDataFrame(list(enumerate(docs)), "i int, tokens array<string>")
    got = phrases.with_phrases(df, "i", min_count=1, threshold=0.5).where("i = 0").first().tokens
    assert got == ["a_b_c"]


@pytest.mark.parametrize(
    "given, language, rest",
    [
        ("Python, C", "Python", "n/a"), ("c#, aes", "C#", "aes"), (" Java, aes", "n/a", "aes"), ("aes,C++ , Go", "C++", "aes"), ("objective, R", "R", "objective"),
        (None, "n/a", "n/a"), ("  ", "n/a", "n/a"), ("openssl", "n/a", "openssl"), ("c, java", "Java", "n/a"),
    ],
)
def test_languages(spark, given, language, rest):
    df = spark.createDataFrame([(given,)], "t string")
    got = df.select(technology.main_language(F.col("t")), technology.without_languages(F.col("t"))).first()
    assert tuple(got) == (language, rest)


def test_terms(spark):
    df = spark.createDataFrame([("AES-128,  aes-256",), ("SHA1, sha512 , Key   Rotation",), (None,)], "t string")
    assert [r[0] for r in df.select(technology.canonical_terms(F.col("t"))).collect()] == ["aes, aes", "sha1, sha, key rotation", None]
    df = spark.createDataFrame([("OpenSSL (20.56)",), ("x (bad)",), ("plain",), ("a (b) (1.5)",)], "t string")
    assert [tuple(r) for r in df.select(technology.name_part(F.col("t")), technology.share_part(F.col("t"))).collect()] == [("openssl", 20.56), ("x", 0.0), ("plain", 0.0), ("a", 1.5)]
