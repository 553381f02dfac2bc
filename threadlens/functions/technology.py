"""Technology lists: one text with comma-separated names."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LANGUAGES, TECHNOLOGY_ALIASES

NONE = "n/a"


def _java_quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}#\-])", r"\\\1", text)


def main_language(technologies: Column, languages=LANGUAGES) -> Column:
    """The first language, in list order, that is an item of the text; ``n/a`` if none is.

    An item is bounded by commas or the ends.  The first item must not begin
    with a blank, so trimming the items is not the same.
    """
    text = F.lower(technologies)
    found = [F.when(text.rlike(rf"(^|,\s*){_java_quoted(lang.lower())}(\s*,|$)"), F.lit(lang)) for lang in languages]
    return F.coalesce(*found, F.lit(NONE))


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda t: F.btrim(t))


def without_languages(technologies: Column, languages=LANGUAGES) -> Column:
    """The list without languages, joined by ``, ``; ``n/a`` if nothing was there or is left."""
    listed = F.array(*[F.lit(lang.lower()) for lang in languages])
    rest = F.filter(_trimmed(technologies), lambda t: ~F.array_contains(listed, F.lower(t)))
    blank = technologies.isNull() | (F.btrim(technologies) == "")
    return F.when(blank | (F.size(rest) == 0), F.lit(NONE)).otherwise(F.array_join(rest, ", "))


def canonical_terms(technologies: Column, aliases=None) -> Column:
    """Lower-case terms with single blanks, each alias replaced by what it counts as; null stays null."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted((aliases or TECHNOLOGY_ALIASES).items()))])
    terms = F.transform(_trimmed(technologies), lambda t: F.regexp_replace(F.lower(t), r"\s+", " "))
    return F.array_join(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), t)), ", ")


def name_part(label: Column) -> Column:
    """``openssl`` of ``openssl (20.5)``."""
    return F.lower(F.btrim(F.split_part(label, F.lit(" ("), F.lit(1))))


def share_part(label: Column) -> Column:
    """20.5 of ``openssl (20.5)``; 0 where there is no number."""
    return F.coalesce(F.regexp_extract(label, r"\(([^()]*)\)\s*$", 1).try_cast("double"), F.lit(0.0))
