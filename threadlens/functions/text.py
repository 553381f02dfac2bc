"""Text normalisation by rules.

Everything but html_text() runs in the JVM.  tokens() uses light suffix rules
and no parts of speech; ``tagging`` has both, for texts to be normalised as the
study's were.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import DISCOURSE_STOPWORDS, FURTHER_STOPWORDS, MEDIUM_STOPWORDS

#: ASCII punctuation that is deleted; underscores and hyphens stay.
PUNCTUATION = "".join(c for c in string.punctuation if c not in "_-")


@lru_cache(maxsize=1)
def stopwords() -> frozenset[str]:
    """English stop words (those that Spark bundles and further ones), words of the medium, and discourse words."""
    return frozenset(StopWordsRemover.loadDefaultStopWords("english")) | FURTHER_STOPWORDS | MEDIUM_STOPWORDS | DISCOURSE_STOPWORDS


def title_and_body(title: Column, body: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def without_code_marks(text: Column) -> Column:
    """Drops fenced blocks, then inline backtick spans."""
    return F.regexp_replace(F.regexp_replace(text, r"```[\s\S]*?```", " "), r"`[^`]*`", " ")


def plain_text(html: Column) -> Column:
    """A JVM-only reduction of markup to text: elements without prose and all tags go, common entities are decoded."""
    out = without_code_marks(F.coalesce(html, F.lit("")))
    out = F.regexp_replace(out, r"(?is)<!--.*?-->", " ")
    out = F.regexp_replace(out, r'(?is)<span[^>]*class="[^"]*math-container[^"]*"[^>]*>.*?</span>', " ")
    out = F.regexp_replace(out, r"(?is)<(code|pre|script|style)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(out, r"[ \t\r\n\f]+", " "))


class _Prose(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.math = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("code", "pre", "script", "style"):
            self.open.append(tag)
        elif tag == "span" and (self.math or "math-container" in (dict(attrs).get("class") or "").split()):
            self.math += 1

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        elif tag == "span" and self.math:
            self.math -= 1

    def handle_data(self, data):
        if not self.open and not self.math:
            self.out.append(data)


def html_to_prose(text: str | None) -> str:
    """Prose of one HTML fragment: no code, formulas, scripts or images; link text stays; blanks collapse."""
    if not text:
        return ""
    text = re.sub(r"`[^`]*`", " ", re.sub(r"```[\s\S]*?```", " ", text))
    parser = _Prose()
    parser.feed(text)
    parser.close()
    return " ".join(" ".join(parser.out).split())


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    """html_to_prose() for a column, with a real HTML tokenizer."""
    return html.map(html_to_prose)


def strip_punctuation(text: Column) -> Column:
    """Deletes ASCII punctuation but _ and -; nothing is put in its place."""
    return F.translate(text, PUNCTUATION, "")


def lemma(token: Column) -> Column:
    """Light English suffix rules on lower-case tokens."""
    n = F.length(token)
    return (
        F.when(token.endswith("ies") & (n > 4), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when(token.rlike("(sses|shes|ches|xes|zes)$"), F.substring(token, F.lit(1), n - 2))
        .when(token.endswith("s") & ~token.rlike("(ss|us|is)$") & (n > 3), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def tokens(text: Column, lemmatise=lemma, stop: frozenset[str] | None = None) -> Column:
    """Lower-case lemmas of two letters and more that are no number, no stop word and not only punctuation."""
    words = F.filter(F.split(F.lower(strip_punctuation(text)), r"\s+"), lambda w: w != "")
    words = F.transform(words, lemmatise) if lemmatise else words
    kept = lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\p{N}+$") & ~w.rlike(r"^[_\-]+$")
    return without_stopwords(F.filter(words, kept), stopwords() if stop is None else stop)


def without_stopwords(words: Column, stop) -> Column:
    """Drops stop words and keeps repeats (a set difference would not); a list of literals becomes a hash set in the plan."""
    return F.filter(words, lambda w: ~w.isin(sorted(stop))) if stop else words


def join_tokens(words: Column) -> Column:
    return F.array_join(words, " ")


def split_tokens(text: Column) -> Column:
    """Tokens of a normalised text: a JSON or quoted list literal, or words parted by blanks."""
    listed = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.when(F.btrim(text).startswith("[") & listed.isNotNull(), listed).otherwise(words)
