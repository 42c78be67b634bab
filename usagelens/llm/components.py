"""Connected components of a link table, without collecting links.

Alternating large-star and small-star steps: each step points the neighbours
of a node to the smallest node it knows. Both are an aggregation and a join on
the node; a node with very many neighbours is combined before the shuffle and
its join partition is one that Spark splits. Each round is written to the
shared folder, so lost executors never replay earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import to_shared


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b: long);
    the component is the smallest node that can be reached. Links of a node to
    itself and repeated links are allowed; an empty table gives none."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = to_shared(edges, "component-edges")
    state = _state(edges)
    while True:
        edges = to_shared(_small_star(_large_star(edges)), "component-edges")
        before, state = state, _state(edges)
        if state == before:  # a star forest: every node points to its component
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a checksum: three numbers, whatever the size."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h), F.max("u")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node get the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours get the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
