"""Aggregate helpers (A7); medians and quantiles are in ``operators.order_stats``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_set(col: str) -> Column:
    """Distinct values as a sorted array (deterministic GROUP_CONCAT DISTINCT)."""
    return F.array_sort(F.collect_set(F.col(col)))
