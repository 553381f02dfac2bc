"""Tolerant conversions of text columns, and time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_or_null(c: Column) -> Column:
    """'' counts as null; applied once, at ingest."""
    return F.when(c != "", c)


def number_or_zero(c: Column) -> Column:
    """The number a text holds; 0 for null, NaN and anything that is no number."""
    number = F.btrim(c.cast("string")).try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(None).cast("double")), F.lit(0.0))


def timestamp_or_null(c: Column) -> Column:
    return F.try_to_timestamp(c)


def safe_date(c: Column) -> Column:
    """The text as it is: dates are not reformatted at ingest, only parsed later."""
    return c


def hours_between(start: Column, end: Column) -> Column:
    """Fractional hours, negative if the end comes first."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def percent(c: Column) -> Column:
    return F.format_string("%.2f%%", c)


def is_not_true(c: Column) -> Column:
    """True for false and for null."""
    return ~c.eqNullSafe(F.lit(True))
