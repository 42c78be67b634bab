"""Skew-safe running aggregates and global ranks.

``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task;
a project holding a third of all commits would then run in one task, and a
window without ``partitionBy`` runs everything in one task. The helpers
below sort with ``repartitionByRange`` instead (sampled boundaries split hot
keys), fix the layout with a reliable checkpoint, and combine per-partition
partial results through small offset tables -- exact, with no task holding
more than about one range partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, key: str, ts: str, tie: str, sums: dict[str, str],
                 descending: bool = False, partitions: int | None = None) -> DataFrame:
    """For each ``out: value`` of ``sums``: the sum of ``value`` over the rows
    of the same ``key`` up to and including this row in (ts, tie) order (or
    descending order) -- all of them in one pass.

    The rows are range-partitioned on (key, ts, tie): the sampled range
    boundaries cut through a hot key (even through one busy day of it), so
    no task holds more than about one partition's share. Per (key,
    partition) a partial sum; a window over that small table gives each
    (key, partition) its offset; a window per (key, partition) adds the
    running part.
    """
    if descending:
        order = [F.col(key), F.col(ts).desc(), F.col(tie).desc()]
    else:
        order = [F.col(key), F.col(ts), F.col(tie)]
    s = _ranged(df, order, partitions)
    part = s.groupBy(key, "_pid").agg(*[F.sum(v).alias("_p_" + o) for o, v in sums.items()])
    w_off = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(key, "_pid", *[F.coalesce(F.sum("_p_" + o).over(w_off), F.lit(0)).alias("_o_" + o)
                                      for o in sums])
    w_in = Window.partitionBy(key, "_pid").orderBy("_mono").rowsBetween(Window.unboundedPreceding, 0)
    out = s.join(part, [key, "_pid"])
    for o, v in sums.items():
        out = out.withColumn(o, F.col("_o_" + o) + F.sum(v).over(w_in))
    return out.drop("_pid", "_mono", *["_o_" + o for o in sums])


def running_sum(df: DataFrame, key: str, ts: str, tie: str, value: str, out: str,
                descending: bool = False, partitions: int | None = None) -> DataFrame:
    """``out`` = sum of ``value`` over the rows of the same ``key`` up to and
    including this row in (ts, tie) order (or descending order)."""
    return running_sums(df, key, ts, tie, {out: value}, descending, partitions)


def row_number(df: DataFrame, key: str, ts: str, tie: str, out: str,
               descending: bool = False, partitions: int | None = None) -> DataFrame:
    """Position (1-based) of each row in its key's (ts, tie) order: a running
    count with the same range-partitioned plan."""
    one = "_one"
    r = running_sum(df.withColumn(one, F.lit(1)), key, ts, tie, one, out, descending, partitions)
    return r.withColumn(out, F.col(out).cast("int")).drop(one)


def _ranged(df: DataFrame, order: list, partitions: int | None) -> DataFrame:
    """Range-partition + sort within partitions (a distributed sort), with
    the partition id and a per-partition increasing id fixed by a reliable
    checkpoint (so the two passes below see the same layout)."""
    from ..session import cut_lineage
    # without a given number the partitions follow the bytes shuffled (adaptive
    # execution joins neighbouring ranges)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    s = (ranged.sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mono", F.monotonically_increasing_id()))
    return cut_lineage(s)


def _offsets(spark, rows: list[tuple], value_type: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, f"_pid int, _first long, _off {value_type}"))


def global_rank(df: DataFrame, order: list, out: str, partitions: int | None = None) -> DataFrame:
    """1-based position of each row in a total ``order`` (make it total with
    a unique tie-break), without a single-partition window: a distributed
    sort, one tiny job for the row count per partition (one row per
    partition reaches the driver), and per-partition offsets."""
    s = _ranged(df, order, partitions)
    stats = sorted(s.groupBy("_pid").agg(F.count("*").alias("c"), F.min("_mono").alias("m0")).collect())
    rows, acc = [], 0
    for r in stats:
        rows.append((r["_pid"], r["m0"], acc))
        acc += r["c"]
    off = _offsets(df.sparkSession, rows, "long")
    return (s.join(off, "_pid")
            .withColumn(out, (F.col("_off") + F.col("_mono") - F.col("_first") + 1).cast("long"))
            .drop("_pid", "_mono", "_first", "_off"))


def global_running_sum(df: DataFrame, order: list, value: str, out: str,
                       partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` over a total ``order`` of all rows, without a
    single-partition window: per range partition the sum (one row per
    partition reaches the driver), offsets, then a window per partition."""
    s = _ranged(df, order, partitions)
    stats = sorted(s.groupBy("_pid").agg(F.sum(value).alias("t"), F.min("_mono").alias("m0")).collect())
    rows, acc = [], 0
    for r in stats:
        rows.append((r["_pid"], r["m0"], acc))
        acc += r["t"] or 0
    off = _offsets(df.sparkSession, rows, "long")
    w = Window.partitionBy("_pid").orderBy("_mono").rowsBetween(Window.unboundedPreceding, 0)
    return (s.join(off, "_pid").withColumn(out, F.col("_off") + F.sum(value).over(w))
            .drop("_pid", "_mono", "_first", "_off"))
