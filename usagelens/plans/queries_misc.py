"""Registered queries of project statistics (T14, V14, S9), table
maintenance on FX-LIST (K4, K6, K7, K9, K10, U1, U3, P3, P6), the outcome
matrix (A19) and the incremental scans (N1, N2)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import exclude, tables
from ..operators.joins import anti, semi
from ..operators.usage import project_overview
from ..session import scratch_path
from ..sources.files import project_vcs_stats
from ..streaming import incremental
from . import fixtures as fx
from .queries import register, study


@register("project_filter")
def q_project_filter(spark, sf):
    return exclude.project_filter(fx.projects(spark, sf)).select("id", "loc")


@register("project_overview")
def q_project_overview(spark, sf):
    return project_overview(exclude.project_filter(fx.projects(spark, sf)))


@register("project_vcs_stats")
def q_vcs(spark, sf):
    ev = fx.read(spark, sf, "events")
    commits = ev.select(F.col("user_id").alias("project_id"), F.col("event_id").cast("string").alias("hash"),
                        F.unix_timestamp("ts").alias("ts_unix"), F.col("event_type").alias("author"),
                        F.when(F.col("value") > 50, F.array(F.lit("p1"), F.lit("p2")))
                        .otherwise(F.array(F.lit("p1"))).alias("parents"))
    return project_vcs_stats(commits)


def _lists(spark, sf):
    part = fx.read(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    target = part.where(F.col("p_partkey") % 2 == 0)
    new = part.where((F.col("p_partkey") % 3 == 0) | (F.col("p_partkey") % 2 == 1))
    return part, target, new


@register("append_if_absent")
def q_append(spark, sf):
    _, target, new = _lists(spark, sf)
    return tables.append_if_absent(target, new, "p_partkey")


@register("flag_where")
def q_flag(spark, sf):
    part, _, new = _lists(spark, sf)
    t = part.withColumn("flag", F.lit(False))
    return tables.flag_where(t, new, "p_partkey", "flag").select("p_partkey", "flag")


@register("delete_where")
def q_delete(spark, sf):
    _, target, new = _lists(spark, sf)
    return tables.delete_where(target, new, "p_partkey").select("p_partkey")


@register("delete_where_not_in")
def q_delete_not_in(spark, sf):
    _, target, new = _lists(spark, sf)
    return tables.delete_where(target, new, "p_partkey", negate=True).select("p_partkey")


@register("reject_known")
def q_reject(spark, sf):
    _, target, new = _lists(spark, sf)
    return tables.reject_known(new, target, "p_partkey").select("p_partkey", "p_name")


@register("find_duplicates")
def q_dups(spark, sf):
    return tables.find_duplicates(fx.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("union_distinct")
def q_union(spark, sf):
    """UNION of five branches (distinct rows)."""
    li = fx.read(spark, sf, "lineitem")
    parts = [li.where(F.col("l_returnflag") == f).select("l_orderkey", F.lit(f).alias("tag")) for f in "ANR"]
    parts.append(li.where(F.col("l_quantity") > 45).select("l_orderkey", F.lit("big").alias("tag")))
    parts.append(li.where(F.col("l_discount") == 0).select("l_orderkey", F.lit("full").alias("tag")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


@register("set_difference")
def q_difference(spark, sf):
    """Parts never ordered in a quantity above 45."""
    part, _, _ = _lists(spark, sf)
    big = fx.read(spark, sf, "lineitem").where(F.col("l_quantity") > 45) \
        .select(F.col("l_partkey").alias("p_partkey"))
    return anti(part.select("p_partkey"), big, "p_partkey")


@register("semi_join")
def q_semi(spark, sf):
    """Parts of some brands ordered with a discount."""
    part, _, _ = _lists(spark, sf)
    li = fx.read(spark, sf, "lineitem").where(F.col("l_discount") > 0.09) \
        .select(F.col("l_partkey").alias("p_partkey"))
    return semi(part.where(F.col("p_type").isin("STANDARD BRASS", "SMALL PLATED COPPER")), li, "p_partkey") \
        .select("p_partkey")


# Outcome names of the tool evaluation, in plot order
OUTCOMES = ["Incorrect", "Missing", "Other error", "Correct"]


@register("outcome_matrix")
def q_outcomes(spark, sf):
    """(tool, outcome) -> sum(Number), one column per outcome."""
    ev = fx.read(spark, sf, "events")
    name = F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), (F.col("user_id") % 4 + 1).cast("int"))
    rows = ev.select(F.col("event_type").alias("tool"), name.alias("outcome"), F.lit(1).alias("number"))
    return rows.groupBy("tool").pivot("outcome", OUTCOMES).agg(F.sum("number")) \
        .select("tool", *[F.coalesce(F.col(f"`{o}`"), F.lit(0)).cast("long").alias(o.replace(" ", "_"))
                          for o in OUTCOMES])


@register("scan_incremental")
def q_scan_incremental(spark, sf):
    """The term scan over the documents table as a stream of four micro-batches
    (each of as many files as the cluster has task slots), appended to a Parquet sink, then a second run that
    finds nothing new. The dictionary lacks the unknown names at first; the
    sink's usages per (project, term) have their ids from the full one."""
    s = study(spark, sf)
    docs_schema = fx.read(spark, sf, "documents").schema
    run = uuid.uuid4().hex[:12]
    sink, ckpt = scratch_path(spark, f"n1-sink-{run}"), scratch_path(spark, f"n1-ckpt-{run}")

    def to_files(docs):
        return fx.files_of(docs)

    src = scratch_path(spark, f"n1-src-{run}")
    docs, slots = fx.read(spark, sf, "documents"), spark.sparkContext.defaultParallelism
    docs.repartition(4 * slots, *docs.columns).write.parquet(src)
    for _ in range(2):
        incremental.scan_incremental(spark, src, docs_schema, to_files, s.known_terms, sink, ckpt,
                                     max_files_per_trigger=slots, unknown_pattern=s.unknown_pattern)
    return incremental.read_usages(spark, sink, s.terms).groupBy("project_id", "term_id") \
        .agg(F.count("*").alias("n"))


@register("history_incremental")
def q_history_incremental(spark, sf):
    """Commit nets from the events table as a stream of several files (one
    per micro-batch, so projects and commits span batches), then a second run
    that finds nothing new."""
    ev_schema = fx.read(spark, sf, "events").schema
    run = uuid.uuid4().hex[:12]
    sink, ckpt = scratch_path(spark, f"n2-sink-{run}"), scratch_path(spark, f"n2-ckpt-{run}")
    src = scratch_path(spark, f"n2-src-{run}")
    fx.read(spark, sf, "events").repartition(4).write.parquet(src)
    for _ in range(2):
        incremental.history_incremental(spark, src, ev_schema, fx.deltas_of, sink, ckpt, max_files_per_trigger=1)
    return incremental.read_history(spark, sink)


@register("metric_catalogue")
def q_catalogue(spark, sf):
    """Every metric of the usage study as (metric, value)."""
    from ..operators.catalogue import catalogue
    from . import queries_history as Q
    i, _ = Q.hist(spark, sf)
    return catalogue(study(spark, sf), i.projects, Q.rated(spark, sf), Q.q_decisions(spark, sf),
                     Q.q_median_commits(spark, sf)).select("metric", "value")


@register("work_queue")
def q_work_queue(spark, sf):
    """The 10 smallest projects not processed yet."""
    from ..operators.usage import work_queue
    return work_queue(fx.projects(spark, sf), 10)
