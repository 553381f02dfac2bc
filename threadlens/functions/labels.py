"""Labels of figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrapped(text: Column, width: int) -> Column:
    """Words put on lines of at most ``width`` characters where they fit; longer words stand alone."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    join = lambda line, w: F.when(line == "", w).when(F.length(F.element_at(F.split(line, "\n"), -1)) + 1 + F.length(w) <= width, F.concat(line, F.lit(" "), w)).otherwise(F.concat(line, F.lit("\n"), w))
    return F.aggregate(words, F.lit(""), join)


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def heading(text: Column) -> Column:
    return F.upper(text)


def initials(text: Column) -> Column:
    """First letters of the words that begin with a capital, as a short form of a category."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"\b([A-Z])"), F.lit(1)), "")
