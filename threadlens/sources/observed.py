"""Stages that are tallied while they are written, and fail if a tally is out of bounds.

Tallies are aggregates of the rows that pass to the writer (DataFrame.observe),
so they cost no scan of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..lineage import remove
from .tables import write_stage


class StageFailed(ValueError):
    """A tally of a stage is out of bounds; ``tallies`` has all of them."""

    def __init__(self, path: str, why: list[str], tallies: dict[str, Any]):
        super().__init__(f"{path}: {'; '.join(why)}")
        self.tallies = tallies


def standard_tallies(df: DataFrame, owner: str = "owner_id", text: str = "body", unique: Iterable[str] = ()) -> dict[str, Column]:
    """rows; null_owners and empty_texts where ``df`` has these columns; about_unique_<c>, null counting as a value."""
    out = {"rows": F.count(F.lit(1))}
    if owner in df.columns:
        out["null_owners"] = F.count_if(F.col(owner).isNull() | (F.col(owner) == ""))
    if text in df.columns:
        out["empty_texts"] = F.count_if(F.col(text).isNull() | (F.btrim(text) == ""))
    for c in unique:
        out[f"about_unique_{c}"] = F.approx_count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("bigint")), F.lit(0))
    return out


def write_observed(df: DataFrame, path: str, tallies: Mapping[str, Column] | None = None, bounds: Mapping[str, tuple[float | None, float | None]] | None = None, partition_by: Iterable[str] = ()) -> tuple[DataFrame, dict[str, Any]]:
    """Writes a stage and returns it as read back, with its tallies.

    ``bounds``: tally -> (least, most), either None.  If one is broken the
    stage's files are removed and StageFailed is raised.  A tally that is null
    (of no rows) breaks any bound but (None, None).
    """
    watch = Observation()
    named = [c.alias(n) for n, c in (tallies or standard_tallies(df)).items()]
    out = write_stage(df.observe(watch, *named), path, partition_by)
    found = dict(watch.get)
    why = [f"{n} is {found.get(n)}, not within {low} and {high}" for n, (low, high) in (bounds or {}).items() if not _within(found.get(n), low, high)]
    if why:
        remove(df.sparkSession, path)
        raise StageFailed(path, why, found)
    return out, found


def _within(value: Any, low: float | None, high: float | None) -> bool:
    if low is None and high is None:
        return True
    return value is not None and (low is None or value >= low) and (high is None or value <= high)
