"""Ratings R1-R7: agreement, consensus, work lists, summaries.

Input: ratings (project_id, user, label), one row per (project, user)
after ``tables.upsert``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_suffix
from .joins import anti

# The rater whose label overrides, the automatic rater, status names
RESOLVER = "resolver-2"
AUTOMATIC = "automatic"
MASS_RATER = "manuel"
UNRESOLVED, RESOLVED = "unresolved", "resolved"
# Label families of the summary
FAMILIES = {
    "increasing": ["mostly increasing", "stable, then increasing"],
    "stagnant": ["increasing, then stable", "spike, then stable", "mostly stable"],
}

# multiplicative hashing constant (2^32 / golden ratio) for the sample
_GOLDEN = 2654435761


def rating_counts(ratings: DataFrame) -> DataFrame:
    """Per item: number of distinct raters and of distinct labels. The sets
    are small (raters and labels of one item), and one aggregate collects them
    without expanding the rows per distinct count."""
    return ratings.groupBy("project_id").agg(
        F.size(F.collect_set("user")).cast("long").alias("nr_users"),
        F.size(F.collect_set("label")).cast("long").alias("nr_labels"))


def rater_agreement(ratings: DataFrame, n_users: int = 3) -> DataFrame:
    """Among items rated by exactly ``n_users`` raters, the number and %
    of items with 1, 2, 3, ... distinct labels."""
    c = rating_counts(ratings).where(F.col("nr_users") == n_users)
    total = c.agg(F.count("*")).scalar()
    g = c.groupBy("nr_labels").agg(F.count("*").alias("items"))
    return g.select("nr_labels", "items", F.round(F.try_divide(F.col("items") * 100.0, total), 6).alias("pct"))


def resolve_ratings(ratings: DataFrame, resolver: str = RESOLVER) -> DataFrame:
    """R2: per item: raters, labels (sorted, ';'-joined), status and final
    label. The resolver's label overrides; otherwise an item whose raters
    agree (one distinct label) is resolved with that label."""
    g = ratings.groupBy("project_id").agg(
        F.size(F.collect_set("user")).cast("long").alias("nr_users"),
        F.size(F.collect_set("label")).cast("long").alias("nr_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ";").alias("labels"),
        F.max(F.when(F.col("user") == resolver, F.col("label"))).alias("_res"),
        F.min("label").alias("_only"))
    status = F.when(F.col("_res").isNotNull(), F.lit(resolver)) \
        .when(F.col("nr_labels") == 1, F.lit(RESOLVED)).otherwise(F.lit(UNRESOLVED))
    final = F.when(F.col("_res").isNotNull(), F.col("_res")) \
        .when(F.col("nr_labels") == 1, F.col("_only"))
    return g.select("project_id", "nr_users", "nr_labels", "labels", status.alias("status"),
                    final.alias("final_label"))


def sample_items(items: DataFrame, pct: int = 15, key: str = "project_id") -> DataFrame:
    """Deterministic pseudo-random subset of about ``pct`` % of the items
    (multiplicative hash of the id: the same item is always in or out). The id
    is multiplied in halves of 16 bits, so no id overflows a long."""
    i = F.col(key).cast("long")
    low, high = (x.bitwiseAND(F.lit(0xFFFF).cast("long")) for x in (i, F.shiftright(i, 16)))
    h = F.pmod(low * F.lit(_GOLDEN) + F.pmod(high * F.lit(_GOLDEN), F.lit(1 << 16)) * F.lit(1 << 16), F.lit(1 << 32))
    return items.where(h * 100 < F.lit(pct) * F.lit(1 << 32))


def worklist(items: DataFrame, ratings: DataFrame, user: str, label: str | None = None,
             subset: DataFrame | None = None, status: str | None = None,
             automatic: str = AUTOMATIC, resolver: str = RESOLVER) -> DataFrame:
    """Items still to rate by ``user`` (rated neither by the user
    nor automatically) -- or, with ``label``, the items the user rated so --
    optionally restricted to a subset and to a consensus status."""
    it = items.select("project_id").distinct()
    if subset is not None:
        it = it.join(subset.select("project_id"), "project_id", "left_semi")
    if label is None:
        done = ratings.where((F.col("user") == user) | (F.col("user") == automatic)).select("project_id")
        out = anti(it, done, "project_id")
    else:
        mine = ratings.where((F.col("user") == user) & (F.col("label") == label)).select("project_id")
        out = it.join(mine, "project_id", "left_semi")
    if status is not None:
        st = resolve_ratings(ratings, resolver).where(F.col("status") == status).select("project_id")
        out = out.join(st, "project_id", "left_semi")
    return out


def label_distribution(ratings: DataFrame) -> DataFrame:
    """Number of ratings per label (order by ``count`` for the table)."""
    return ratings.groupBy("label").agg(F.count("*").alias("count"))


def family_of(label: Column, families: dict = FAMILIES) -> Column:
    out = F.lit(None).cast("string")
    for fam, labels in families.items():
        out = F.when(label.isin(*labels), F.lit(fam)).otherwise(out)
    return out


def decision_summary(ratings: DataFrame, n_checked: DataFrame, families: dict = FAMILIES,
                     resolver: str = RESOLVER, automatic: str = AUTOMATIC,
                     mass_rater: str = MASS_RATER) -> DataFrame:
    """(decision, count, pct) for the final decisions of the
    resolved items (% of resolved items), the automatic labels and the
    mass-rater share (% of checked items, ``n_checked`` one-row table
    ``n``), and the family subtotals; UNION of the parts (distinct rows),
    with the metric-name suffix of each decision."""
    final = resolve_ratings(ratings, resolver).where(F.col("final_label").isNotNull())
    tot = final.agg(F.count("*")).scalar()
    checked = n_checked.select("n").scalar()
    dec = final.groupBy(F.col("final_label").alias("decision")).agg(F.count("*").alias("count")) \
        .select("decision", "count", F.try_divide(F.col("count") * 100.0, tot).alias("pct"))
    auto = ratings.where(F.col("user") == automatic).groupBy(F.col("label").alias("decision")) \
        .agg(F.count("*").alias("count")) \
        .select("decision", "count", F.try_divide(F.col("count") * 100.0, checked).alias("pct"))
    mass = ratings.where(F.col("user") == mass_rater).agg(F.count("*").alias("count")) \
        .select(F.lit("not automatic").alias("decision"), "count",
                F.try_divide(F.col("count") * 100.0, checked).alias("pct"))
    fam = dec.withColumn("family", family_of(F.col("decision"), families)).where(F.col("family").isNotNull()) \
        .groupBy(F.col("family").alias("decision")).agg(F.sum("count").alias("count"), F.sum("pct").alias("pct"))
    out = dec.unionByName(auto).unionByName(mass).unionByName(fam.select("decision", "count", "pct")).distinct()
    return out.select("decision", F.col("count").cast("long").alias("count"),
                      F.round("pct", 6).alias("pct"), label_suffix(F.col("decision")).alias("metric"))


def ratings_of(ratings: DataFrame) -> DataFrame:
    """Per item its (user, label) pairs (sorted) and whether it has
    exactly one rating."""
    g = ratings.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("user", "label"))).alias("pairs"),
        F.count("*").alias("n"))
    return g.select("project_id",
                    F.array_join(F.transform("pairs", lambda p: F.concat_ws("=", p["user"], p["label"])), ";")
                    .alias("ratings"), (F.col("n") == 1).alias("single"))
