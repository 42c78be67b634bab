"""Table maintenance K4-K10 as pure functions returning the new table.

Each function takes the current table and the change and returns the table
after the change; writing it back is the caller's job (``sources.sinks``),
which keeps every step re-runnable after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import anti, broadcast_checked
from .windows import global_rank


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def append_if_absent(target: DataFrame, new: DataFrame, key) -> DataFrame:
    """K4: INSERT OR IGNORE -- rows of ``new`` whose key is not yet in
    ``target`` are appended (the first writer wins; duplicates inside ``new``
    keep the row that sorts first on all columns)."""
    k = _keys(key)
    fresh = anti(new, target.select(*k), k)
    w = Window.partitionBy(*k).orderBy(*[F.col(c).asc_nulls_first() for c in new.columns])
    fresh = fresh.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return target.unionByName(fresh)


def upsert(target: DataFrame, new: DataFrame, key) -> DataFrame:
    """K5: INSERT OR REPLACE -- a row of ``new`` replaces the target row with
    the same key (the last writer wins; within ``new`` the row with the
    largest optional ``_seq`` value -- any orderable type -- is the last; rows
    of one ``_seq`` are ordered by their other columns)."""
    k = _keys(key)
    if "_seq" not in new.columns:
        new = new.withColumn("_seq", F.lit(0))
    seq_type = new.schema["_seq"].dataType
    old = anti(target, new.select(*k), k).withColumn("_seq", F.lit(None).cast(seq_type)) \
        .withColumn("_prio", F.lit(0))
    both = old.unionByName(new.select(*target.columns, "_seq").withColumn("_prio", F.lit(1)))
    # groups are one key each: at most the writers of one row
    w = Window.partitionBy(*k).orderBy(
        F.col("_prio").desc(), F.col("_seq").desc_nulls_last(),
        *[F.col(c).desc_nulls_last() for c in target.columns if c not in k])
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_seq", "_prio")


def flag_where(target: DataFrame, keys: DataFrame, key, flag: str) -> DataFrame:
    """K6: UPDATE target SET flag = true WHERE key IN (keys)."""
    k = _keys(key)
    hit = broadcast_checked(keys.select(*k).distinct().withColumn("_hit", F.lit(True)))
    out = target.join(hit, k, "left")
    return out.withColumn(flag, F.when(F.col("_hit"), F.lit(True)).otherwise(F.col(flag))) \
        .drop("_hit").select(*target.columns)


def delete_where(target: DataFrame, keys: DataFrame, key, negate: bool = False) -> DataFrame:
    """K7: DELETE FROM target WHERE key IN (keys) -- or NOT IN when
    ``negate`` (NULL keys of ``keys`` are ignored, the anti-join semantics)."""
    k = _keys(key)
    if negate:
        return target.join(keys.select(*k).distinct(), k, "left_semi")
    return anti(target, keys.select(*k), k)


def extend_dictionary(terms: DataFrame, names: DataFrame, defaults: dict) -> DataFrame:
    """K8: give unseen names a new id and append them with the given attribute
    values; each name gets one id."""
    return terms.unionByName(new_entries(terms, names, defaults))


def new_entries(terms: DataFrame, names: DataFrame, defaults: dict) -> DataFrame:
    """The rows that ``extend_dictionary`` appends: unseen names with the id
    ``max(id) + rank`` (ranked by name), so the same two inputs give the same ids.

    The ranking is a distributed sort of the new names (``global_rank``),
    not a single-partition window.
    """
    new = anti(names.select("name").where(F.col("name").isNotNull()).distinct(),
               terms.select("name"), "name")
    base = terms.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    ranked = global_rank(new, [F.col("name")], "_rank")
    added = ranked.select(
        (base + F.col("_rank")).cast("long").alias("id"), "name",
        *[F.lit(v).alias(c) for c, v in defaults.items()])
    for c in terms.columns:
        if c not in added.columns:
            added = added.withColumn(c, F.lit(None).cast(terms.schema[c].dataType))
    return added.select(*[F.col(c).cast(terms.schema[c].dataType) for c in terms.columns])


def assign_ids(parts: list[DataFrame], schema) -> DataFrame:
    """K8 for a whole dictionary at once: disjoint name groups (each with all
    attribute columns but ``id``) get ids 1..n in (group, name) order -- the
    ids ``extend_dictionary`` would give when the groups are added one after
    the other -- with a single distributed rank."""
    tagged = [p.withColumn("_grp", F.lit(i)) for i, p in enumerate(parts)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t)
    ranked = global_rank(u, [F.col("_grp"), F.col("name")], "id")
    return ranked.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def reject_known(new: DataFrame, existing: DataFrame, key: str = "url") -> DataFrame:
    """K9: drop incoming rows whose key already exists; duplicates in the
    input keep the first row by all columns."""
    return append_if_absent(existing.limit(0), anti(new, existing.select(key), key), key)


def find_duplicates(df: DataFrame, key) -> DataFrame:
    """Keys that occur more than once, with their count."""
    k = _keys(key)
    return df.groupBy(*k).agg(F.count("*").alias("count")).where("count > 1")
