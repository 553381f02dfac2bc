"""From dumps to popular threads, and from threads to classified questions.

Each stage takes and returns DataFrames; write_stage() of sources.tables puts
Parquet between two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Site
from ..functions.tagging import tagged_tokens
from ..functions.text import html_text, join_tokens, title_and_body
from ..lineage import scratch
from ..operators import census, quality, tag_relatedness, threads
from ..operators.phrases import with_phrases
from ..schema import require
from ..sources import dumps
from ..sources.observed import write_observed


@dataclass
class Mined:
    census: DataFrame
    coarse: DataFrame
    related: DataFrame
    threads: DataFrame
    popular: DataFrame
    #: Of each stage that is written: rows, posts without an owner, empty texts.
    tallies: dict[str, dict]


def related_tags(posts: DataFrame, sites: Iterable[Site]) -> DataFrame:
    """site, tag, b, a, h1, h2 by each site's first anchor and thresholds, without its denied tags."""
    parts = []
    for site in sites:
        own = dumps.questions(posts).where(F.col("site") == site.alias)
        parts.append(tag_relatedness.above_thresholds(tag_relatedness.tag_metrics(own, site.anchors[0]), site.threshold_1, site.threshold_2))
    found = reduce(DataFrame.unionByName, parts)
    return tag_relatedness.without_denied(found, dumps.denied_tags(posts.sparkSession, sites))


def mine(spark: SparkSession, root: str, sites: tuple[Site, ...], work: str | None = None, bounds: Mapping[str, Mapping[str, tuple]] | None = None) -> Mined:
    """All mining stages over unpacked dumps below ``root``.

    The dumps are parsed once and kept as Parquet, as are the related tags and
    the threads, below ``work`` (by default in the shared folder).  Stages are
    tallied while they are written; ``bounds`` (stage -> tally -> least and
    most) fail a stage, such as posts without any row.
    """
    work, tallies = work or scratch(spark, "mining"), {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        out, tallies[name] = write_observed(df, f"{work}/{name}", bounds=(bounds or {}).get(name))
        return out

    posts = stage("posts", dumps.read_posts(spark, root, sites))
    comments = stage("comments", dumps.read_comments(spark, root, sites))
    known = dumps.site_table(spark, sites)
    counted = census.with_total(census.site_census(posts, comments, known))
    coarse = reduce(DataFrame.unionByName, [tag_relatedness.coarse_questions(dumps.questions(posts).where(F.col("site") == s.alias), s.anchors) for s in sites])
    related = stage("related", related_tags(posts, sites))
    chosen = tag_relatedness.related_questions(dumps.questions(posts), related)
    unified = stage("threads", threads.unified_posts(chosen, dumps.answers(posts), comments, known))
    return Mined(counted, coarse, related, unified, quality.popular_threads(unified), tallies)


def normalise(posts: DataFrame, key: str = "id", tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds tokens (phrases joined) and normalized_text, and drops title and body.

    Tokens are the lemmas of nouns, verbs, adjectives and adverbs (tagging), or
    what ``tokens`` makes of the prose, such as text.tokens for rules that stay
    in the JVM.  Phrases are mined from non-empty documents; empty ones stay as
    rows.  ``key`` must be unique; ids are so only together with the type.
    """
    require(posts, "type", key, title="text", body="text")
    rows = posts.withColumn("_key", F.concat_ws("/", F.col("type"), F.col(key)))
    prose = html_text(title_and_body(F.col("title"), F.col("body")))
    rows = rows.withColumn("tokens", tokens(prose) if tokens else tagged_tokens(posts.sparkSession, prose))
    rows = with_phrases(rows, "_key")
    return rows.withColumn("normalized_text", join_tokens(F.col("tokens"))).drop("_key", "title", "body")
