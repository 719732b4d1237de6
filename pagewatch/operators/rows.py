"""Unfolding arrays that are computed, not stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(rows: DataFrame, keep: list[str], records: Column | str, present: str) -> DataFrame:
    """One row per struct of an array; `present` is a field that is never null in a struct.

    A plain `inline` makes the optimizer infer a filter on the array and push
    it below the projections that compute it, which would parse every page a
    second time, once per use of a parsed field. The outer form with a filter
    on its output gives the same rows without that.
    """
    column = F.col(records) if isinstance(records, str) else records
    unfolded = rows.select(*keep, F.inline_outer(column))
    return unfolded.filter(F.col(present).isNotNull())
