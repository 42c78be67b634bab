"""Join helpers: size-checked broadcast and null-safe set filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension is broadcast only if the optimizer's size of its plan, in bytes,
# is at most this; beyond it the hint is left out and Spark chooses the join
# (adaptive execution still broadcasts a side that turns out to be small).
BROADCAST_MAX_BYTES = 64 << 20


def broadcast_checked(dim: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(dim)`` if its planned size is at most ``max_bytes``, else
    ``dim`` unchanged. Reads the plan's statistics only: no job is run and no
    verdict is kept."""
    size = dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(dim) if size <= max_bytes else dim


def semi(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other`` (IN subquery)."""
    return df.join(other, on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``.

    A NOT IN over a subquery is rewritten to an anti join on non-null keys,
    which Spark can run as a shuffle join; the null-aware form would force a
    broadcast of the subquery.
    """
    if isinstance(on, str):
        other = other.where(F.col(on).isNotNull())
    elif isinstance(on, (list, tuple)) and all(isinstance(c, str) for c in on):
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).isNotNull()
        other = other.where(cond)
    return df.join(other, on, "left_anti")
