import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.functions import english, tagging, text
from threadlens.plans import mining

# Sentences that the tagger has not learned from, labelled by hand.
HELD_OUT = """The/D client/N checks/V the/D certificate/N chain/N before/C it/O accepts/V the/D connection/N
I/O would/X like/V to/T know/V whether/C this/D scheme/N is/X really/R secure/A
Each/D block/N of/I plaintext/N is/X combined/V with/I the/D previous/A ciphertext/N
You/O can/X recover/V the/D plaintext/N if/C the/D nonce/N repeats/V
Several/A libraries/N offer/V constant/A time/N comparison/N functions/N
Our/D company/N stores/V credit/N cards/N in/I an/D encrypted/A table/N
Why/R does/X the/D decryption/N fail/V on/I Windows/P but/C not/T on/I Linux/P
A/D quantum/N computer/N could/X factor/V large/A integers/N efficiently/R
The/D padding/N oracle/N attack/N exploits/V detailed/A error/N messages/N
Nobody/O has/X published/V a/D practical/A attack/N against/I this/D cipher/N yet/R
She/O carefully/R compared/V both/D signatures/N and/C found/V no/D difference/N
Password/N managers/N help/V users/N choose/V unique/A passwords/N
It/O seems/V that/C the/D token/N expires/V after/I ten/M minutes/N
Do/X not/T hardcode/V secrets/N in/I your/D source/N code/N
Elliptic/A curves/N provide/V the/D same/A security/N with/I shorter/A keys/N
They/O recently/R migrated/V their/D infrastructure/N to/I Amazon/P
What/D kind/N of/I certificate/N does/X the/D browser/N expect/V
This/D approach/N works/V well/R for/I small/A files/N
Verifying/V a/D signature/N is/X usually/R faster/A than/I creating/V one/O
The/D random/A generator/N must/X be/X seeded/V properly/R"""


def accuracy(sentences):
    """(share of right tags, share of right decisions whether a word is kept)."""
    got = tagging.default_tagger().tag([[w for w, _ in s] for s in sentences])
    pairs = [(want, tag) for s, tags in zip(sentences, got) for (_, want), tag in zip(s, tags)]
    return np.mean([a == b for a, b in pairs]), np.mean([(a in tagging.CONTENT) == (b in tagging.CONTENT) for a, b in pairs])


def test_held_out_accuracy():
    tags, kept = accuracy(english.examples(HELD_OUT))
    assert tags >= 0.88 and kept >= 0.95
    rare = frozenset(english.VERBS.split()[::7] + english.NOUNS.split()[::7] + english.ADJECTIVES.split()[::7])
    new = tagging.train(english.examples() * tagging.TIMES + english.sentences(tagging.DRAWN, leave=rare))
    drawn = [s for s in english.sentences(600, 99) if any(w in rare for w, _ in s)]
    got = new.tag([[w for w, _ in s] for s in drawn])
    assert len(drawn) > 100 and np.mean([b == c for s, t in zip(drawn, got) for (w, b), c in zip(s, t) if w in rare]) > 0.85


def test_best_sequences_equal_brute_force():
    rng = np.random.default_rng(1)
    tagger = tagging.Tagger(("a", "b", "c"), {}, rng.standard_normal((4, 3)).round(1))
    scores = [rng.standard_normal((n, 3)).round(1) for n in (1, 5, 0, 3, 6, 5)]
    for got, s in zip(tagger.best(scores), scores):
        def total(seq):
            return sum(s[t, k] + tagger.moves[seq[t - 1] if t else 3, k] for t, k in enumerate(seq))
        assert total(got) == pytest.approx(max(map(total, itertools.product(range(3), repeat=len(s)))))
        assert len(got) == len(s)
    assert tagger.best([]) == []


def test_texts_are_tagged_alike_alone_and_together():
    tagger = tagging.default_tagger()
    texts = [[w for w, _ in s] for s in english.sentences(50, 3)] + [[]]
    assert tagger.tag(texts) == [tagger.tag([t])[0] for t in texts]


@pytest.mark.parametrize(("word", "pos", "lemma"), [
    ("keys", "NOUN", "key"), ("policies", "NOUN", "policy"), ("boxes", "NOUN", "box"), ("children", "NOUN", "child"), ("status", "NOUN", "status"), ("process", "NOUN", "process"), ("analyses", "NOUN", "analysis"),
    ("running", "VERB", "run"), ("making", "VERB", "make"), ("encrypted", "VERB", "encrypt"), ("went", "VERB", "go"), ("tries", "VERB", "try"), ("dropped", "VERB", "drop"), ("computing", "VERB", "compute"), ("implementing", "VERB", "implement"), ("is", "VERB", "be"),
    ("bigger", "ADJ", "big"), ("easiest", "ADJ", "easy"), ("better", "ADJ", "good"), ("quickly", "ADV", "quickly"), ("x", "NOUN", "x"), ("s", "NOUN", "s"),
])
def test_lemmas(word, pos, lemma):
    assert tagging.default_lemmas().of(word, pos) == lemma


def test_lemmas_of_the_table_are_all_right():
    lemmas = tagging.default_lemmas()
    known = {}
    for form, pos, lemma in english.forms() + english.irregular_forms():
        known.setdefault((form, pos), set()).add(lemma)
    assert all(lemmas.of(*key) in found for key, found in known.items())


def test_tokens_keep_content_words_only(spark):
    texts = ["The keys were generated quickly by a 2048 bit function!", "", None, "-- __ 42", "I found that this works, and everyone uses it.", "Alice sends encrypted messages to Bob"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: r.tokens for r in df.select("i", tagging.tagged_tokens(spark, F.col("t")).alias("tokens")).collect()}
    assert got[0] == ["key", "generate", "quickly", "bit", "function"]
    assert (got[1], got[2], got[3]) == ([], None, [])
    assert got[4] == []
    assert got[5] == ["send", "encrypted", "message"] or got[5] == ["send", "encrypt", "message"]


def test_stop_words_are_the_union(spark):
    from threadlens.plans import catalog

    assert {"the", "whereupon", "thereby", "seems", "twelve", "thread", "found", "couldn"} <= text.stopwords() and len(text.stopwords()) > 400
    assert set(catalog._STOP) == text.stopwords()


def test_normalise(spark):
    posts = spark.createDataFrame([(str(i), "question", "Weak keys", "<p>The weak key leaks secrets.</p><code>key()</code>") for i in range(8)] + [("9", "answer", None, None)], "id string, type string, title string, body string")
    out = {r.id: r for r in mining.normalise(posts).collect()}
    assert out["9"].tokens == [] and out["9"].normalized_text == ""
    assert "leak" in out["1"].normalized_text and "the" not in out["1"].normalized_text.split()
    rules = {r.id: r.normalized_text for r in mining.normalise(posts, tokens=text.tokens).collect()}
    assert rules["9"] == "" and rules["1"]


def test_portions_bound_what_is_held(monkeypatch):
    texts = ["the keys were stored in new files", None, "", "users sign certificates " * 40, "old servers failed"] * 6
    tagger, lemmas = tagging.default_tagger(), tagging.default_lemmas()
    want = tagging.content_tokens(texts, tagger, lemmas, frozenset())
    held = []
    tag = tagging.Tagger.tag
    monkeypatch.setattr(tagging.Tagger, "tag", lambda self, words: held.append(sum(map(len, words))) or tag(self, words))
    monkeypatch.setattr(tagging, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(tagging, "REMEMBERED", 5)
    for x in (tagger, lemmas):
        x._known.clear()
    assert tagging.content_tokens(texts, tagger, lemmas, frozenset()) == want
    assert max(held) <= 120 and len(held) > 6 and len(tagger._known) <= 5 and len(lemmas._known) <= 5
