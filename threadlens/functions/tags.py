"""Tag lists and site-qualified ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that str.strip() removes, as far as tags are concerned.
_EDGES = " \t\r\n\f\v"


def _parts(raw: Column, separator: str) -> Column:
    parts = F.transform(F.split(raw, separator), lambda p: F.btrim(p, F.lit(_EDGES)))
    return F.filter(parts, lambda p: p != "")


def parse_tags(raw: Column) -> Column:
    """Tags of a raw field: ``<a><b>`` first, then ``a;b``, then ``a|b``, else any of blanks and , ; |.

    Null and empty give an empty array.  Angle brackets win if both occur, and
    their contents are not trimmed.
    """
    bracketed = F.regexp_extract_all(raw, F.lit("<(.+?)>"), F.lit(1))
    return (
        F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>"))
        .when(raw.contains("<") & raw.contains(">"), bracketed)
        .when(raw.contains(";"), _parts(raw, ";"))
        .when(raw.contains("|"), _parts(raw, r"\|"))
        .otherwise(_parts(raw, r"[\s,;\|]+"))
    )


def join_tags(tags: Column) -> Column:
    """Distinct tags in order, joined by ``;``."""
    return F.array_join(F.array_sort(F.array_distinct(tags)), ";")


def qualified_id(alias: Column, id_: Column) -> Column:
    """``alias:id``; null for a null or empty id."""
    return F.when(id_.isNotNull() & (id_.cast("string") != ""), F.concat_ws(":", alias, id_.cast("string")))


def question_link(alias: Column, qualified: Column) -> Column:
    """Address of a question from ``alias:id`` or a bare id; '' for null.

    The alias inside the id counts only if the alias column is null or empty.
    Ids like ``5.0`` become ``5``.
    """
    two = F.size(F.split(qualified, ":")) == 2
    own = F.when(two & (alias.isNull() | (alias == "")), F.split_part(qualified, F.lit(":"), F.lit(1))).otherwise(alias)
    id_ = F.when(two, F.split_part(qualified, F.lit(":"), F.lit(2))).otherwise(qualified)
    id_ = F.coalesce(id_.try_cast("double").try_cast("bigint").cast("string"), id_)
    domain = F.when(own == "stackoverflow", F.lit("stackoverflow.com")).otherwise(F.concat(F.coalesce(own, F.lit("nan")), F.lit(".stackexchange.com")))
    return F.when(qualified.isNull(), F.lit("")).otherwise(F.concat(F.lit("https://"), domain, F.lit("/questions/"), id_))


def threshold_label(threshold_1: Column, threshold_2: Column) -> Column:
    """Name of a point of the threshold grid, as in ``TRH1_0.050_TRH2_0.001``."""
    return F.format_string("TRH1_%.3f_TRH2_%.3f", threshold_1, threshold_2)


def threshold_file(threshold_1: Column, threshold_2: Column) -> Column:
    """File name of a point of the grid, as in ``TRH1_0_050_TRH2_0_001.csv``."""
    return F.concat(F.replace(threshold_label(threshold_1, threshold_2), F.lit("."), F.lit("_")), F.lit(".csv"))
