"""Distributed order statistics (A4-A6, A14, L2): medians, median-by rows and
interpolated quantiles of whole columns or of groups.

Equal values are counted first (a partial aggregate), the distinct values get a
running count over a distributed sort (``windows.running_sums``), and the
row at rank r is the value with ``before <= r < before + n``. So no buffer holds
a column, several columns share one pass, integers stay integers (no cast to
double), and nothing passes the driver but the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .joins import broadcast_checked
from .windows import running_sums

_REAL = (T.DoubleType, T.FloatType)


def ranked_values(df: DataFrame, values: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """(*by, name, whole, real, n, before, total): every distinct value of each
    named column within its group, how often it occurs, how many smaller values
    there are and how many in all. Integers are in ``whole``, floating-point
    values in ``real``. Nulls are left out."""
    by = by or []
    kinds = dict(zip(values, df.select(*values.values()).schema.fields))
    rows = []
    for name, value in values.items():
        real = isinstance(kinds[name].dataType, _REAL)
        rows.append(F.struct(F.lit(name).alias("name"),
                             (F.lit(None) if real else value).cast("long").alias("whole"),
                             (value if real else F.lit(None)).cast("double").alias("real")))
    counted = df.select(*by, F.inline(F.array(*rows))).where("whole IS NOT NULL OR real IS NOT NULL") \
        .groupBy(*by, "name", "whole", "real").agg(F.count("*").alias("n"))
    keyed = counted.withColumn("_key", F.struct(*by, "name"))
    ranked = running_sums(keyed, "_key", "whole", "real", {"_upto": "n"})
    totals = ranked.groupBy("_key").agg(F.max("_upto").alias("total"))
    return ranked.join(broadcast_checked(totals), "_key").select(
        *by, "name", "whole", "real", "n", (F.col("_upto") - F.col("n")).alias("before"), "total")


def at_rank(rank: Column) -> Column:
    """Whether a row of ``ranked_values`` holds the value at this 0-based rank."""
    return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))


def upper_median_row(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """A4 / L2: one row with, for each named column, the value at offset
    ``n div 2`` of its ascending order (null without values). All columns are
    ranked in one pass; a null does not count."""
    kinds = dict(zip(values, df.select(*values.values()).schema.fields))
    middle = ranked_values(df, values).where(at_rank(F.expr("total div 2")))
    return middle.agg(*[F.max(F.when(F.col("name") == n, F.col(
        "real" if isinstance(kinds[n].dataType, _REAL) else "whole"))).alias(n) for n in values])


def upper_median(df: DataFrame, column: str) -> Column:
    """The upper median of one column, as a scalar."""
    return upper_median_row(df, {column: F.col(column)}).scalar()


def median_by_row(df: DataFrame, by: str, id_col: str) -> DataFrame:
    """A5: one row with ``id_col`` of the row at offset ``n div 2`` of the
    (by, id) order; no row for an empty table.

    The value of ``by`` at that offset is found first, then the row among those
    that share it."""
    middle = ranked_values(df, {by: F.col(by)}).where(at_rank(F.expr("total div 2"))) \
        .select("whole", "real", F.expr("total div 2 - before").alias("_place"))
    real = isinstance(df.schema[by].dataType, _REAL)
    ties = df.select(by, id_col).join(F.broadcast(middle), F.col(by) == F.col("real" if real else "whole"))
    return ranked_values(ties, {id_col: F.col(id_col)}, ["_place"]).where(at_rank(F.col("_place"))) \
        .select(F.col("whole").alias(id_col))


def quantiles(ranked: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of ``value`` (an increasing function of
    the ranked values) per group: with h = (total - 1) * share the values at
    ranks floor(h) and floor(h) + 1, weighted by the fraction of h."""
    h = {name: (F.col("total") - 1) * F.lit(share) for name, share in shares.items()}
    ends = []
    for name in shares:
        low = F.floor(h[name])
        ends += [F.max(F.when(at_rank(low), value)).alias(f"_{name}_low"),
                 F.max(F.when(at_rank(low + 1), value)).alias(f"_{name}_high")]
    out = ranked.groupBy(*by).agg(F.max("total").alias("total"), *ends)
    for name in shares:
        low, high = F.col(f"_{name}_low"), F.coalesce(f"_{name}_high", f"_{name}_low")
        out = out.withColumn(name, low + (high - low) * (h[name] - F.floor(h[name])))
    return out.select(*by, *shares)
