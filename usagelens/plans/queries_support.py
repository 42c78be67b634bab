"""Registered queries of the support order (C1-C4) and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators import support as S
from ..sources.sinks import materialise
from . import fixtures as fx
from .queries import register

_NEEDS: dict = {}


def needs_table(spark, sf):
    """The (project, term) needs, materialised once per data set (every
    support query reads them several times)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _NEEDS:
        _NEEDS[key] = materialise(fx.needs(spark, sf), "needs")
    return _NEEDS[key]

FX_LIBC = "libc"
COVER_DIMS = {"p_size": "band", "p_retailprice": "band", "p_type": "equal", "p_brand": "equal"}
COVER_DIMS_SD = {"p_size": "sd", "p_retailprice": "sd", "p_type": "equal", "p_brand": "equal"}


@register("support_by_frequency")
def q_freq(spark, sf):
    return S.support_by_frequency(needs_table(spark, sf), libc_category=FX_LIBC)


@register("support_by_frequency_independent")
def q_freq_ind(spark, sf):
    return S.support_by_frequency(needs_table(spark, sf), assume_specific=True, libc_category=FX_LIBC)


@register("support_greedy")
def q_greedy(spark, sf):
    return S.support_greedy(needs_table(spark, sf), libc_category=FX_LIBC)


@register("support_greedy_independent")
def q_greedy_ind(spark, sf):
    return S.support_greedy(needs_table(spark, sf), assume_specific=True, libc_category=FX_LIBC)


@register("start_configuration")
def q_start(spark, sf):
    needs = needs_table(spark, sf)
    parts = []
    for libc in (False, True):
        for spec in (False, True):
            cand, done = S.start_configuration(needs, libc, spec, FX_LIBC)
            tag = F.lit(f"libc={int(libc)},specific={int(spec)}")
            parts.append(cand.select(tag.alias("config"), "term_id", F.lit("candidate").alias("role")))
            parts.append(done.select(tag.alias("config"), "term_id", F.lit("implemented").alias("role")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("support_thresholds")
def q_thresholds(spark, sf):
    needs = needs_table(spark, sf)
    return S.support_thresholds({"most_frequent": S.support_by_frequency(needs, libc_category=FX_LIBC),
                                 "greedy": S.support_greedy(needs, libc_category=FX_LIBC)})


def _cover(spark, sf):
    return fx.cover_universe(spark, sf), fx.cover_sample(spark, sf)


@register("coverage_score")
def q_cover(spark, sf):
    u, s = _cover(spark, sf)
    return C.coverage_score(u, s, COVER_DIMS)


@register("coverage_score_sd")
def q_cover_sd(spark, sf):
    u, s = _cover(spark, sf)
    return C.coverage_score(u, s, COVER_DIMS_SD)


@register("coverage_by_dimension")
def q_cover_dims(spark, sf):
    u, s = _cover(spark, sf)
    return C.coverage_by_dimension(u, s, COVER_DIMS)


@register("coverage_inputs")
def q_cover_inputs(spark, sf):
    part = fx.read(spark, sf, "part").withColumnRenamed("p_partkey", "repository")
    ours = fx.cover_sample(spark, sf)
    u, s = C.coverage_inputs(part, ours, F.col("p_type").endswith("BRASS"), list(COVER_DIMS))
    return C.coverage_score(u, s, COVER_DIMS)


@register("coverage_next")
def q_cover_next(spark, sf):
    u, s = _cover(spark, sf)
    return C.coverage_next(u, s, COVER_DIMS, 5)
