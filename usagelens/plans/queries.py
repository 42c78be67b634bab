"""Registered queries: one per operator of the inventory, each a function
``(spark, sf_dir) -> DataFrame`` over the bound test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exclude, scan, usage
from ..sources.files import explode_lines
from ..session import configure
from . import fixtures as fx
from .study import UsageStudy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_STUDIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def study(spark: SparkSession, sf_dir: str) -> UsageStudy:
    """One study per (session, data set): its materialised tables are shared
    by all usage queries, as the study's persisted views are."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:
        configure(spark)
        inputs = fx.usage_inputs(spark, sf_dir)
        _STUDIES[key] = UsageStudy(inputs, unknown_pattern=fx.FX_UNKNOWN_PATTERN)
    return _STUDIES[key]


# ----------------------------------------------------------------- T1-T14
@register("scan_terms")
def q_scan_terms(spark, sf):
    return study(spark, sf).usages_raw.select("project_id", "path", "line_nr", "term_id", "excluded")


@register("discover_terms")
def q_discover_terms(spark, sf):
    return study(spark, sf).internal_names


@register("unknown_terms")
def q_unknown_terms(spark, sf):
    return study(spark, sf).terms.where(F.col("category") == scan.UNKNOWN_CATEGORY).select("id", "name")


@register("count_pattern")
def q_count_pattern(spark, sf):
    s = study(spark, sf)
    return scan.count_pattern(s.lines, fx.FX_ASM_NAMES, projects=s.i.projects)


@register("config_flags")
def q_config_flags(spark, sf):
    mk = explode_lines(study(spark, sf).i.makefiles)
    return scan.config_flags(mk, freestanding=fx.FX_FREESTANDING, no_builtin=fx.FX_NO_BUILTIN,
                             projects=study(spark, sf).i.projects)


@register("extract_names")
def q_extract_names(spark, sf):
    return scan.extract_names(study(spark, sf).i.pages, "html", fx.FX_DOC_PATTERN)


@register("classify_fragments")
def q_classify_fragments(spark, sf):
    s = study(spark, sf)
    return s.with_lines(s.fragments_auto)


@register("sync_manual")
def q_sync_manual(spark, sf):
    s = study(spark, sf)
    return s.with_lines(s.fragments)


@register("mark_excluded")
def q_mark_excluded(spark, sf):
    return study(spark, sf).usages_marked.groupBy("project_id").agg(
        F.count("*").alias("nr_usages"), F.count_if("excluded").alias("nr_excluded"))


@register("vendored_usages")
def q_vendored(spark, sf):
    return study(spark, sf).usages_raw.groupBy("project_id").agg(
        F.count_if("vendored").alias("nr_vendored"),
        F.count("*").alias("nr_usages"))


@register("filtered_usages")
def q_filtered(spark, sf):
    return study(spark, sf).usages.groupBy("project_id", "term_id").agg(F.count("*").alias("n"))


def _shares(spark, sf, by_term):
    s = study(spark, sf)
    return exclude.exclusion_shares(s.usages_raw, s.fragments, s.projects, s.studied_terms, by_term)


@register("exclusion_shares")
def q_shares(spark, sf):
    return _shares(spark, sf, True)


@register("exclusion_shares_legacy")
def q_shares_legacy(spark, sf):
    return _shares(spark, sf, False)


@register("rare_undocumented")
def q_rare(spark, sf):
    s = study(spark, sf)
    return exclude.rare_undocumented(s.usages, s.terms)


# ----------------------------------------------------------------- V1-V16
@register("unique_usages")
def q_unique_usages(spark, sf):
    return usage.unique_usages(study(spark, sf).usages)


@register("term_counts")
def q_term_counts(spark, sf):
    return usage.term_counts(study(spark, sf).usages)


for _ms, _nm in [(True, "specific"), (False, "independent")]:
    register(f"category_counts_{_nm}")(
        lambda spark, sf, _ms=_ms: usage.category_counts(study(spark, sf).usages, _ms))
    register(f"category_usage_table_{_nm}")(
        lambda spark, sf, _ms=_ms: usage.category_usage_table(
            study(spark, sf).studied_terms, usage.term_counts(study(spark, sf).usages), _ms))


@register("projects_by_unique_terms")
def q_projects_unique(spark, sf):
    return usage.projects_by_terms(study(spark, sf).usages, 15, unique=True)


@register("projects_by_usages")
def q_projects_usages(spark, sf):
    return usage.projects_by_terms(study(spark, sf).usages, 15, unique=False)


@register("unused_by_category")
def q_unused(spark, sf):
    s = study(spark, sf)
    return usage.unused_by_category(s.studied_terms, usage.term_counts(s.usages))


@register("top_terms")
def q_top_terms(spark, sf):
    s = study(spark, sf)
    return usage.top_terms(s.usages, s.i.synonyms, 10)


@register("synonym_breakdown")
def q_synonyms(spark, sf):
    s = study(spark, sf)
    return usage.synonym_breakdown(s.usages, s.i.synonyms)


@register("top_file_names")
def q_top_files(spark, sf):
    return usage.top_file_names(study(spark, sf).usages, 10)


@register("usage_density")
def q_density(spark, sf):
    return usage.usage_density(study(spark, sf).usages)


for _u in (False, True):
    for _ms, _sfx in [(None, ""), (True, "_specific"), (False, "_independent")]:
        register(f"usage_distribution{'_unique' if _u else ''}{_sfx}")(
            lambda spark, sf, _u=_u, _ms=_ms: usage.usage_distribution(study(spark, sf).usages, _u, _ms))


@register("boxplot_rows")
def q_boxplot_rows(spark, sf):
    return usage.boxplot_rows(study(spark, sf).usages, unique=True)


@register("boxplot_summary")
def q_boxplot_summary(spark, sf):
    return usage.boxplot_summary(usage.boxplot_rows(study(spark, sf).usages, unique=False))


for _k in (50, 100):
    register(f"top_{_k}_composition")(
        lambda spark, sf, _k=_k: usage.top_k_composition(study(spark, sf).usages, _k))
