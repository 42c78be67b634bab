"""Usage analytics V1-V16 over the filtered usage table.

Input columns: project_id, path, line_nr, line, term_id, excluded, loc, url,
project_name, term_name, category, machine_specific, documented, header.

Every operator aggregates with map-side partial aggregation first; the few
global results (medians, ranks over terms) work on already aggregated,
dimension-sized data (one row per term, category or project).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import sorted_set
from ..functions.text import base_name, idiv, natural_join
from .joins import broadcast_checked
from .order_stats import median_by_row, quantiles, ranked_values, upper_median

KIND = {True: "machine-specific", False: "machine-independent"}


def unique_usages(usages: DataFrame) -> DataFrame:
    """V1: distinct (project, term) with the term's attributes."""
    # the attributes depend on the term only: grouping on all of them is a
    # hash aggregate (dropDuplicates would keep first() buffers, sort-based)
    return usages.select("project_id", "term_id", "term_name", "category", "machine_specific").distinct()


def term_counts(usages: DataFrame) -> DataFrame:
    """V2: number of projects per used term (distinct first, then count:
    both steps combine map-side, so a hot term costs no single task)."""
    return unique_usages(usages).groupBy("term_id", "term_name", "category", "machine_specific") \
        .agg(F.count("*").alias("projects"))


def project_total(usages: DataFrame) -> DataFrame:
    """Number of projects with at least one usage (one-row DataFrame)."""
    return usages.select("project_id").distinct().agg(F.count("*").alias("nr_projects"))


def category_counts(usages: DataFrame, machine_specific: bool | None = None) -> DataFrame:
    """V3: projects per category (optionally of one kind); order with
    ``orderBy(F.col("projects").desc())`` where a ranking is wanted (L5)."""
    u = usages if machine_specific is None else \
        usages.where(F.col("machine_specific") == F.lit(machine_specific))
    return (u.select("project_id", "category").distinct().groupBy("category")
            .agg(F.count("*").alias("projects")))


def per_project(usages: DataFrame, unique: bool) -> DataFrame:
    """Usages (or distinct terms) per project."""
    if unique:
        return usages.select("project_id", "term_id").distinct().groupBy("project_id") \
            .agg(F.count("*").alias("count"))
    return usages.groupBy("project_id").agg(F.count("*").alias("count"))


def projects_by_terms(usages: DataFrame, k: int = 15, unique: bool = True) -> DataFrame:
    """V4 / V5: top-k projects by distinct terms (unique) or by usages:
    url, KLOC (integer), count. Ties by project id."""
    counts = per_project(usages, unique)
    # counted first: a string buffer per project (as of dropDuplicates) would sort all usages
    attrs = usages.groupBy("project_id", "url", "loc").agg(F.count("*").alias("_n")) \
        .groupBy("project_id").agg(F.max_by(F.struct("url", "loc"), "_n").alias("_a")) \
        .select("project_id", "_a.url", "_a.loc")
    return (counts.join(attrs, "project_id")
            .select("project_id", "url", idiv("loc", 1000).alias("kloc"), "count")
            .orderBy(F.col("count").desc(), "project_id").limit(k))


def category_usage_table(terms: DataFrame, counts: DataFrame,
                         machine_specific: bool) -> DataFrame:
    """V6: per (category, header) of one kind: number of terms and the % of
    them used = 100 - unused documented * 100 / number of terms (100 when a
    category has no unused documented term)."""
    used = counts.select("term_id").withColumn("_used", F.lit(True))
    t = terms.where(F.col("machine_specific") == F.lit(machine_specific)) \
        .join(used, terms.id == used.term_id, "left")
    unfound = t.where(F.col("_used").isNull() & F.col("documented")) \
        .groupBy("category").agg(F.count("*").alias("unfound"))
    out = t.groupBy("category", "header").agg(F.count("name").alias("nr_terms"))
    out = out.join(unfound, "category", "left")
    pct = F.when(F.col("unfound").isNull(), F.lit(100.0)) \
        .otherwise(100.0 - F.try_divide(F.col("unfound") * 100.0, F.col("nr_terms")))
    return out.select("category", "header", "nr_terms", F.round(pct, 6).alias("pct_used"))


def unused_by_category(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """V7 / V8: per category the documented terms never used: number, % of
    all terms of the category, and the sorted name list as ``a, b, and c``."""
    used = counts.select(F.col("term_id").alias("id")).withColumn("_used", F.lit(True))
    t = terms.join(used, "id", "left")
    unused = F.col("_used").isNull() & F.col("documented")
    agg = t.groupBy("category").agg(
        F.count_if(unused).alias("nr_unused"), F.count("*").alias("nr_terms"),
        F.array_sort(F.collect_list(F.when(unused, F.col("name")))).alias("_names"))
    return agg.where("nr_unused > 0").select(
        "category", "nr_unused", F.round(F.try_divide(F.col("nr_unused") * 100.0, F.col("nr_terms")), 6)
        .alias("pct_unused"), natural_join("_names").alias("unused_names"))


def top_terms(usages: DataFrame, synonyms: DataFrame, k: int = 10) -> DataFrame:
    """The k terms used by most projects: name, category,
    synonym (sub-category), projects and % of all projects with usages."""
    counts = term_counts(usages)
    top = counts.orderBy(F.col("projects").desc(), "term_id").limit(k)
    syn = broadcast_checked(synonyms.select(F.col("name").alias("term_name"), "synonym"))
    total = project_total(usages).scalar()
    return (top.join(syn, "term_name", "left")
            .select("term_id", "term_name", "category", "synonym", "projects",
                    F.round(F.try_divide(F.col("projects") * 100.0, total), 6).alias("pct_projects")))


def synonym_breakdown(usages: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Used terms per synonym (sub-category): number of terms and the
    largest / total project count."""
    counts = term_counts(usages)
    syn = broadcast_checked(synonyms.select(F.col("name").alias("term_name"), "synonym"))
    return counts.join(syn, "term_name").groupBy("synonym").agg(
        F.count("*").alias("nr_terms"), F.max("projects").alias("max_projects"),
        F.sum("projects").alias("sum_projects"))


def top_file_names(usages: DataFrame, k: int = 10) -> DataFrame:
    """The k file base names found in most projects: average number of
    distinct terms per (project, file name), projects, number of distinct
    term sets and the most common set (ties: smallest set)."""
    per = usages.select("project_id", base_name("path").alias("file_name"), "term_name") \
        .distinct().groupBy("project_id", "file_name") \
        .agg(F.count("*").alias("n_terms"), F.array_join(sorted_set("term_name"), ",").alias("term_set"))
    sets = per.groupBy("file_name", "term_set").agg(F.count("*").alias("n"))
    best = sets.groupBy("file_name").agg(
        F.count("*").alias("nr_sets"),
        F.min_by("term_set", F.struct(-F.col("n"), F.col("term_set"))).alias("top_set"))
    files = per.groupBy("file_name").agg(F.round(F.avg("n_terms"), 6).alias("avg_terms"),
                                         F.count("*").alias("projects"))
    top = files.orderBy(F.col("projects").desc(), "file_name").limit(k)
    return top.join(best, "file_name")


def usage_density(usages: DataFrame) -> DataFrame:
    """LOC per usage per project (integer division): min, max, avg,
    upper median."""
    per = usages.groupBy("project_id").agg(F.count("*").alias("n"), F.max("loc").alias("loc"))
    every = per.select(idiv("loc", F.col("n")).alias("every_x"))
    median = upper_median(every, "every_x")
    return every.agg(F.min("every_x").alias("min_every_x"), F.max("every_x").alias("max_every_x"),
                     F.round(F.avg("every_x"), 6).alias("avg_every_x")) \
        .select("*", median.alias("median_every_x"))


def usage_distribution(usages: DataFrame, unique: bool = False,
                       machine_specific: bool | None = None) -> DataFrame:
    """Over projects: max, average and upper median of the number of
    usages (or distinct terms), optionally of one kind of term."""
    u = usages if machine_specific is None else \
        usages.where(F.col("machine_specific") == F.lit(machine_specific))
    per = per_project(u, unique)
    median = upper_median(per, "count")
    return per.agg(F.max("count").alias("max_count"), F.round(F.avg("count"), 6).alias("avg_count")) \
        .select("*", median.alias("median_count"))


def boxplot_rows(usages: DataFrame, unique: bool) -> DataFrame:
    """Per project a row per kind with a non-zero count plus a
    ``total`` row (GROUPING SETS ((project, kind), (project)))."""
    u = usages.select("project_id", F.when(F.col("machine_specific"), KIND[True])
                      .otherwise(KIND[False]).alias("kind"), "term_id")
    if unique:
        u = u.distinct()
    g = u.groupBy(F.col("project_id"), F.col("kind")).agg(F.count("*").alias("count"))
    total = g.groupBy("project_id").agg(F.sum("count").alias("count")) \
        .select("project_id", F.lit("total").alias("kind"), "count")
    # same result as GROUPING SETS, but the total re-aggregates the small
    # per-kind result instead of re-reading the usages
    return g.unionByName(total)


def boxplot_summary(rows: DataFrame) -> DataFrame:
    """Per kind on log10 scale: quartiles (interpolated), whiskers
    (most extreme values within 1.5 IQR) and number of outliers."""
    lx = F.log10("whole")
    ranked = ranked_values(rows, {"count": F.col("count")}, ["kind"])
    q = quantiles(ranked, ["kind"], lx, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    inside = (lx >= F.col("q1") - 1.5 * iqr) & (lx <= F.col("q3") + 1.5 * iqr)
    # whiskers and outliers from the counted values, not from the rows again
    out = ranked.join(broadcast_checked(q), "kind").groupBy("kind", "q1", "median", "q3").agg(
        F.min(F.when(inside, lx)).alias("lower"), F.max(F.when(inside, lx)).alias("upper"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"), F.max("total").alias("n"))
    return out.select("kind", *[F.round(c, 6).alias(c) for c in ["q1", "median", "q3", "lower", "upper"]],
                      "outliers", "n")


def top_k_composition(usages: DataFrame, k: int = 50) -> DataFrame:
    """How many of the k most frequent terms fall in each category
    and kind (one pass over the top-k)."""
    top = term_counts(usages).orderBy(F.col("projects").desc(), "term_id").limit(k)
    return top.groupBy("category", "machine_specific").agg(F.count("*").alias("nr_in_top"))


def project_overview(projects: DataFrame) -> DataFrame:
    """For LOC, commits, committers, first and last commit: min, max,
    avg and the value on the project that is the upper median by LOC
    (median-by, A5; ties by id), in long form."""
    p = projects.select("id", "loc", "commits", "committers", "first_commit", "last_commit")
    mid = median_by_row(p, "loc", "id").scalar()
    of_mid = F.col("id") == mid
    seconds = {m: F.unix_timestamp(F.col(m).cast("timestamp")).cast("double") for m in ("first_commit", "last_commit")}

    def line(metric: str, value: Column, avg: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), F.min(value).cast("double").alias("min_value"),
                        F.max(value).cast("double").alias("max_value"), avg.cast("double").alias("avg_value"),
                        F.max(F.when(of_mid, value)).cast("double").alias("median_by_loc"))

    lines = [line(m, F.col(m), F.round(F.avg(m), 6)) for m in ("loc", "commits", "committers")]
    lines += [line(m, v, F.lit(None)) for m, v in seconds.items()]
    # one aggregate of all values, then a row per metric
    return p.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def work_queue(projects: DataFrame, n: int, done: str = "processed") -> DataFrame:
    """The next ``n`` projects to process: not done yet, smallest first
    (by C LOC, ties by id) -- a top-n (TakeOrderedAndProject), no sort of the
    whole table."""
    loc = F.coalesce(F.col("loc_c"), F.lit(0)) + F.coalesce(F.col("loc_h"), F.lit(0))
    return (projects.where(~F.col(done).eqNullSafe(True)).withColumn("loc", loc.cast("long"))
            .orderBy("loc", "id").limit(n).select("id", "loc"))
