"""Sinks K1-K3: delimited files, one file set per project, materialised views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def write_delimited(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    """K1: header CSV written by the executors (one part file per partition)."""
    df.write.mode(mode).option("header", "true").option("sep", sep).csv(path)


def write_series_per_project(df: DataFrame, path: str, key: str = "project_key", sep: str = ";",
                             mode: str = "overwrite", order: tuple[str, ...] = ("date",),
                             partitions: int | None = None) -> None:
    """K2: one directory ``key=<value>`` per project holding its series in
    ``order``: rows are range-partitioned by (key, order), so a project of any
    size is cut into numbered parts, and its files in name order, each from top
    to bottom, are the series. A few tasks hold a project, one task many small ones."""
    # a key that cannot be null keeps the sort order up to the writer
    rows = df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("")))
    by = [key, *order]
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    (ranged.sortWithinPartitions(*by)
     .write.mode(mode).partitionBy(key).option("header", "true").option("sep", sep).csv(path))


def project_key(id_col="project_id", owner="owner", name="name"):
    """K2 file key ``<id>-<owner>-<name>``."""
    return F.concat_ws("-", F.col(id_col).cast("string"), F.col(owner), F.col(name))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """K3: write a view as a Parquet table below the shared checkpoint folder
    and read it back: later queries start from the table (lineage cut, no
    recomputation, survives executor loss)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def materialise_all(views: dict, order: list[str]) -> dict:
    """K3: materialise views in dependency order; each view is a function of
    the already materialised ones (``views[name](done) -> DataFrame``)."""
    done: dict = {}
    for name in order:
        done[name] = materialise(views[name](done), name)
    return done
