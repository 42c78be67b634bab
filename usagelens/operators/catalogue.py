"""The metric catalogue -- every scalar metric of the study as one row
(metric, value, percentage), plus the metrics generated per category and per
label.

Each base table is read once: its metrics are one aggregate whose values are
turned into rows. The dictionary is first counted per category, which gives the
per-category metrics and, added up, the totals; usages are first counted
per project. Medians of all per-project columns share one ranking
(``order_stats``). Formatting follows F13 (thousands separators, no decimals,
``%`` for percentages).

Metric names are fixed values, those of the study's reports. Names generated from
categories keep their digits, so that two categories never share a name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_metric, idiv, label_suffix
from ..sources.sinks import materialise
from . import exclude, usage
from .joins import broadcast_checked
from .order_stats import upper_median_row
from .ratings import rating_counts

# The composition metrics of the most frequent terms: name, top k, category
TOP_CATEGORIES = [
    ("topOtherBuiltins", 50, "other"), ("topSyncBuiltins", 50, "sync"), ("topAtomicBuiltins", 100, "atomic"),
    ("topOtherLibcBuiltins", 100, "other-libc"), ("topInternalBuiltins", 100, "GCC internal"),
    ("topAddressBuiltins", 100, "address"), ("offsetofBuiltins", 100, "offsetof"),
    ("objectSizeBuiltins", 100, "object-size"), ("overflowBuiltins", 100, "overflow"),
    ("topPowerpcAltivecBuiltins", 100, "powerpc-altivec"), ("topArmCBuiltins", 100, "arm-c-extensions"),
]
# Fixed value: category whose studied terms are counted
OTHER_CATEGORY = "other"


def as_rows(row: DataFrame, metrics: dict[str, Column], pct: dict[str, Column] | None = None) -> DataFrame:
    """(metric, value, percentage) of each metric of a table's rows."""
    cells = [F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value"), F.lit(p).alias("percentage"))
             for p, group in ((False, metrics), (True, pct or {})) for n, v in group.items()]
    return row.select(F.inline(F.array(*cells)))


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def term_metrics(study, counts: DataFrame) -> DataFrame:
    """Metrics of the dictionary, from one aggregate per category."""
    top = counts.orderBy(F.desc("projects"), "term_id").limit(100)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("projects"), "term_id")))
    used = counts.select(F.col("term_id").alias("id"), "projects")
    excluded = broadcast_checked(study.i.excluded_terms.select("name").distinct().withColumn("_out", F.lit(True)))
    t = study.terms.join(excluded, "name", "left").join(used, "id", "left") \
        .join(F.broadcast(top.select(F.col("term_id").alias("id"), "place")), "id", "left")
    listed = F.col("_out").isNull()
    unknown = F.col("category").eqNullSafe(exclude.UNKNOWN_CATEGORY)
    ms, doc, is_used = F.col("machine_specific"), F.col("documented"), F.col("projects").isNotNull()
    studied = listed & ~unknown
    parts = {
        "terms": studied, "specific": listed & ms & doc, "independent": listed & ~ms & doc, "unknown": unknown,
        "not_documented": studied & ~doc, "documented": listed & doc, "used": is_used,
        "rare": ~doc & (F.col("projects") <= 1), "top50": F.col("place") <= 50, "top100": F.col("place") <= 100,
        "top_specific": (F.col("place") <= 100) & ms, "listed": listed,
        "specific_used": studied & doc & ms & is_used, "specific_unused": studied & doc & ms & ~is_used,
        "independent_used": studied & doc & ~ms & is_used, "independent_unused": studied & doc & ~ms & ~is_used,
    }
    per = materialise(t.groupBy("category").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in parts.items()]),
                      "category-counts")
    unused = F.col("specific_unused") + F.col("independent_unused")
    found = per.where(unused > 0)
    name = lambda prefix: F.concat(F.lit(prefix), F.replace(F.col("category"), F.lit("-"), F.lit("")))
    by_category = found.select(F.inline(F.array(
        F.struct(name("nrUnused").alias("metric"), unused.cast("double").alias("value"), F.lit(False).alias("percentage")),
        F.struct(name("percentageUnused").alias("metric"), _share(unused, F.col("terms")).alias("value"),
                 F.lit(True).alias("percentage")))))
    of = lambda category, column: F.sum(F.when(F.col("category") == category, F.col(column)).otherwise(0))
    total = per.agg(*[F.sum(n).alias(n) for n in parts], of("GCC internal", "listed").alias("internal"),
                    of(OTHER_CATEGORY, "terms").alias("other"),
                    *[of(c, f"top{k}").alias(n) for n, k, c in TOP_CATEGORIES])
    c = F.col
    doc_used, doc_unused = c("specific_used") + c("independent_used"), c("specific_unused") + c("independent_unused")
    totals = as_rows(total, {
        "nrTotalTerms": c("terms"), "nrBuiltins": c("terms"), "nrArchitectureSpecificBuiltins": c("specific"),
        "nrArchitectureIndependentBuiltins": c("independent"), "nrGCCInternalBuiltins": c("internal"),
        "nrNotDefBuiltins": c("not_documented"), "nrUnknownBuiltins": c("unknown"), "nrDefBuiltins": c("documented"),
        "nrUsedBuiltins": c("used"), "builtinsWithLessThanTwoOccurrences": c("rare"), "nrOtherBuiltins": c("other"),
        "topMachineSpecificBuiltins": c("top_specific"), **{n: c(n) for n, _, _ in TOP_CATEGORIES},
        "numberDefBuiltinsUsed": doc_used, "numberDefBuiltinsNotUsed": doc_unused,
        "nrMachineSpecificBuiltinsUsed": c("specific_used"), "nrMachineIndependentBuiltinsUsed": c("independent_used"),
        "nrMachineSpecificBuiltinsUnused": c("specific_unused"),
        "nrMachineIndependentBuiltinsUnused": c("independent_unused"),
    }, {
        "percentageDefBuiltinsUsed": _share(doc_used, doc_used + doc_unused),
        "percentageDefBuiltinsNotUsed": _share(doc_unused, doc_used + doc_unused),
        "percentageUnusedMachineSpecificBuiltins": _share(c("specific_unused"), c("specific_used") + c("specific_unused")),
        "percentageUnusedMachineIndependetBuiltins": _share(
            c("independent_unused"), c("independent_used") + c("independent_unused")),
    })
    return totals.unionByName(by_category)


def project_metrics(study, history_projects: DataFrame) -> DataFrame:
    """Metrics of projects, their usages and their history, from one table
    with a row per project."""
    per_term = study.usages.groupBy("project_id", "term_id", "machine_specific").agg(F.count("*").alias("n"))
    ms = F.col("machine_specific")
    per = per_term.groupBy(F.col("project_id").alias("id")).agg(
        F.sum("n").alias("n"), F.sum(F.when(ms, F.col("n"))).alias("n_specific"),
        F.sum(F.when(~ms, F.col("n"))).alias("n_independent"), F.count("*").alias("u"),
        F.sum(F.when(ms, 1)).alias("u_specific"), F.sum(F.when(~ms, 1)).alias("u_independent"))
    kept = study.projects.select("id", "loc", F.lit(True).alias("kept"))
    history = history_projects.select("id", F.col("history_checked").alias("checked"))
    p = study.i.projects.select("id", "processed", "stars").join(kept, "id", "left").join(per, "id", "left") \
        .join(history, "id", "left").withColumn("every", idiv("loc", F.col("n")))
    p = materialise(p, "project-counts")
    kept = F.coalesce("kept", F.lit(False))
    checked = kept & F.col("checked").eqNullSafe(True)
    row = p.agg(
        F.count_if("processed").alias("processed"), F.count_if(kept).alias("projects"),
        F.min(F.when(kept, F.col("stars"))).alias("from_stars"), F.max(F.when(kept, F.col("stars"))).alias("to_stars"),
        F.sum("loc").alias("loc"), F.count("n").alias("with"), F.count_if(checked).alias("checked"),
        F.count_if(kept & ~F.col("checked").eqNullSafe(True) & F.col("n").isNotNull()).alias("not_checked"),
        *[F.count(c).alias("with_" + c) for c in ("n_specific", "n_independent")],
        *[F.coalesce(F.sum(c), F.lit(0)).alias("sum_" + c) for c in ("n", "u", "n_specific", "n_independent")],
        *[f(c).alias(f"{g}_{c}") for c in ("n", "u", "every") for g, f in (("max", F.max), ("min", F.min), ("avg", F.avg))])
    c = F.col
    rows = as_rows(row, {
        "nrProjectsUnfiltered": c("processed"), "nrProjects": c("projects"), "nrFromStars": c("from_stars"),
        "nrToStars": c("to_stars"), "totalMLoc": idiv("loc", 1_000_000), "maxNrBuiltinsPerProject": c("max_n"),
        "avgNrBuiltinsPerProject": c("avg_n"), "kBuiltins": idiv("sum_n", 1000),
        "kProjectUniqueBuiltins": idiv("sum_u", 1000), "nrProjectsWithBuiltins": c("with"),
        "maxNumberUniqueBuiltinsPerProject": c("max_u"), "avgNumberUniqueBuiltinsPerProject": c("avg_u"),
        "avgBuiltinEveryXLOC": c("avg_every"), "minBuiltinEveryXLOC": c("min_every"), "maxBuiltinEveryXLOC": c("max_every"),
        "nrProjectsWithMachineIndependentBuiltins": c("with_n_independent"),
        "nrProjectsWithMachineSpecificBuiltins": c("with_n_specific"),
        "kMachineSpecificBuiltinsTotal": idiv("sum_n_specific", 1000),
        "kMachineIndependentBuiltinsTotal": idiv("sum_n_independent", 1000),
        "numberProjectsGitHistoryProcessed": c("checked"), "numberProjectsNotAnalyzed": c("not_checked"),
    }, {
        "percentageProjectsWithBuiltins": _share(c("with"), c("projects")),
        "percentageProjectsGitHistoryProcessed": _share(c("checked"), c("with")),
    })
    medians = {"medianNrBuiltinsPerProject": "n", "medianNrMachineSpecificBuiltinsPerProject": "n_specific",
               "medianNrMachineIndependentBuiltinsPerProject": "n_independent", "medianNumberUniqueBuiltinsPerProject": "u",
               "medianNumberMachineSpecificUniqueBuiltinsPerProject": "u_specific",
               "medianNumberMachineIndependentUniqueBuiltinsPerProject": "u_independent",
               "medianBuiltinEveryXLOC": "every"}
    middle = upper_median_row(p, {n: F.col(col) for n, col in medians.items()})
    return rows.unionByName(as_rows(middle, {n: F.col(n) for n in medians}))


def exclusion_metrics(study) -> DataFrame:
    """Metrics of the exclusion: one reason per usage."""
    shares = exclude.exclusion_shares(study.usages_raw, study.fragments, study.projects, study.studied_terms)
    rows = as_rows(shares, {
        "nrKRemovedByDoubleQuotes": idiv("nr_quotes", 1000), "kBuiltinsUnfiltered": idiv("nr_raw", 1000),
    }, {
        "percentageRemovedByDoubleQuotes": F.col("pct_quotes"), "percentageBuiltinFilteredByComments": F.col("pct_comment"),
        "percentageFilteredByCompilerDirectories": F.col("pct_vendored"),
        "percentageFilteredByBlacklist": F.col("pct_manual"), "percentageFilteredBuiltins": F.col("pct_kept"),
    })
    manual = study.fragments.agg(F.count_if(F.col("category") == exclude.MANUAL).alias("n"))
    return rows.unionByName(as_rows(manual, {"nrBlacklist": F.col("n")}))


def rating_metrics(ratings: DataFrame, decisions: DataFrame, label_medians: DataFrame) -> DataFrame:
    """Metrics of the ratings: agreement of three raters, counts and shares
    per decision (R6), medians per label (H10)."""
    items = rating_counts(ratings).join(ratings.groupBy("project_id").agg(F.count("*").alias("n")), "project_id")
    three = F.col("nr_users") == 3
    row = items.agg(F.sum("n").alias("n"), F.count_if(three).alias("three"),
                    *[F.count_if(three & (F.col("nr_labels") == k)).alias(f"labels{k}") for k in (1, 2, 3)])
    share = lambda k: _share(F.col(f"labels{k}"), F.col("three"))
    rows = as_rows(row, {"numberProjectsTrendAnalyzed": F.coalesce("n", F.lit(0))}, {
        "classificationsNrAgreed": share(1), "classificationsNrTwoAgreed": share(2), "classificationsAllDisagreed": share(3)})
    named = lambda df, prefix, suffix, value, pct: df.select(
        F.concat(F.lit(prefix), suffix).alias("metric"), F.col(value).cast("double").alias("value"),
        F.lit(pct).alias("percentage"))
    return reduce(DataFrame.unionByName, [
        rows, named(decisions, "nr", F.col("metric"), "count", False), named(decisions, "percentage", F.col("metric"), "pct", True),
        named(label_medians, "median", label_suffix("label"), "median_commits", False)])


def catalogue(study, history_projects: DataFrame, ratings: DataFrame, decisions: DataFrame,
              label_medians: DataFrame) -> DataFrame:
    """All metrics of a ``UsageStudy``, its projects' history flags (id,
    history_checked), ratings (project_id, user, label), decision summary (R6)
    and medians per label (H10)."""
    out = reduce(DataFrame.unionByName, [
        term_metrics(study, usage.term_counts(study.usages)), project_metrics(study, history_projects),
        exclusion_metrics(study), rating_metrics(ratings, decisions, label_medians)])
    fmt = F.when(F.col("percentage"), format_metric(F.col("value"), True)).otherwise(format_metric(F.col("value")))
    return out.select("metric", F.round("value", 6).alias("value"), fmt.alias("formatted"))
