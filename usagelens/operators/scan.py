"""Text mining T1-T6: the term scan and the dictionary discovery around it.

The scan is a tokenise + equi-join: every identifier of a line is emitted by
``regexp_extract_all`` and matched against the (broadcast, size-checked)
dictionary. That is exactly "every whole-identifier occurrence of a name"
because all names are identifiers, and it runs inside one codegen stage with
no shuffle -- the scanned text is never moved between executors.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import DOC_NAME, identifiers
from .joins import anti, broadcast_checked

# Fixed value: identifiers with this prefix are usages even when the
# dictionary does not know them (they become "Unknown" terms).
UNKNOWN_PATTERN = "^__builtin_[a-zA-Z0-9]"
# Identifiers that mark inline assembly.
ASM_NAMES = ["__asm__", "asm"]
# Build flags looked for in makefiles.
FREESTANDING_FLAG = "-ffreestanding"
NO_BUILTIN_FLAG = "-fno-builtin"
# Categories of terms that are not from the documentation.
INTERNAL_CATEGORY = "GCC internal"
UNKNOWN_CATEGORY = "Unknown"


def tokens(lines: DataFrame, line: str = "line") -> DataFrame:
    """F1 applied: one row per identifier occurrence (``token``) of a line."""
    return lines.select("*", F.explode(identifiers(line)).alias("token"))


def scan_terms(lines: DataFrame, terms: DataFrame,
               unknown_pattern: str | None = UNKNOWN_PATTERN) -> DataFrame:
    """Every occurrence of a dictionary name (several per line possible).

    Output: the line columns + ``term`` (name) + ``term_id`` (NULL for an
    identifier that only matches ``unknown_pattern``; see ``unknown_terms``).
    """
    cols = [F.col("name").alias("token"), F.col("id").alias("term_id")]
    dim = broadcast_checked(terms.select(*cols))
    toks = tokens(lines)
    if unknown_pattern:
        fits, prefix = F.col("token").rlike(unknown_pattern), literal_prefix(unknown_pattern)
        if prefix:  # cheaper than the expression, for most tokens
            fits = F.col("token").startswith(prefix) & fits
        hits = toks.join(dim, "token", "left").where(F.col("term_id").isNotNull() | fits)
    else:
        hits = toks.join(dim, "token", "inner")
    return hits.withColumnRenamed("token", "term")


def resolve_term_ids(usages: DataFrame, terms: DataFrame) -> DataFrame:
    """Fill ``term_id`` of usages found by pattern once the dictionary knows
    them (after ``extend_dictionary``)."""
    dim = broadcast_checked(terms.select(F.col("name").alias("term"), F.col("id").alias("_id")))
    return usages.join(dim, "term", "left") \
        .withColumn("term_id", F.coalesce("term_id", "_id")).drop("_id")


def literal_prefix(pattern: str) -> str | None:
    """The literal identifier characters that every match of an anchored
    pattern starts with (``^__builtin_[a-z]`` -> ``__builtin_``), or None. An
    alternative anywhere gives none, and a character that a quantifier may
    make optional is not part of the prefix (``^ab*c`` -> ``a``)."""
    m = re.match(r"\^([A-Za-z0-9_]+)", pattern)
    if not m or "|" in pattern:
        return None
    prefix = m.group(1)
    if pattern[m.end():m.end() + 1] in ("?", "*", "{"):
        prefix = prefix[:-1]
    return prefix or None


def discover_terms(lines: DataFrame, terms: DataFrame, pattern: str = UNKNOWN_PATTERN) -> DataFrame:
    """Distinct identifiers matching ``pattern`` that the dictionary
    does not know (every one of a line, not only those before a known name).

    Only lines containing the pattern's literal prefix can hold a match, so
    a byte search skips all other lines, and only identifiers that start with
    it are taken out of a line."""
    prefix = literal_prefix(pattern)
    if prefix:
        starting = F.lit(f"(?<![A-Za-z0-9_]){prefix}[A-Za-z0-9_]*")
        found = lines.where(F.col("line").contains(prefix)) \
            .select(F.explode(F.regexp_extract_all("line", starting, F.lit(0))).alias("token"))
    else:
        found = tokens(lines)
    found = found.where(F.col("token").rlike(pattern)) \
        .select(F.col("token").alias("name")).distinct()
    return anti(found, terms.select("name"), "name")


def unknown_terms(usages: DataFrame) -> DataFrame:
    """Names of pattern-matched usages without an id."""
    return usages.where(F.col("term_id").isNull()).select(F.col("term").alias("name")).distinct()


def count_pattern(lines: DataFrame, names: list[str] = ASM_NAMES,
                  key: str = "project_id", out: str = "nr_asm", projects: DataFrame | None = None) -> DataFrame:
    """T4: per project, occurrences of any of ``names`` as a whole identifier
    (partial aggregation per task, then one small shuffle). With ``projects``
    (column ``id``) every project has a row, 0 if nothing was found."""
    # a name list of a few entries: membership test on the token, no join
    found = tokens(lines).where(F.col("token").isin(*names)) \
        .groupBy(key).agg(F.count("*").alias(out))
    return _for_all(projects, found, key, {out: F.lit(0).cast("long")})


def _for_all(projects: DataFrame | None, found: DataFrame, key: str, missing: dict) -> DataFrame:
    """A row per project; ``missing`` has the values of one without rows."""
    if projects is None:
        return found
    out = projects.select(F.col("id").alias(key)).distinct().join(found, key, "left")
    return out.select(key, *[F.coalesce(F.col(c), v).alias(c) for c, v in missing.items()])


def config_flags(makefile_lines: DataFrame, key: str = "project_id",
                 freestanding: str = FREESTANDING_FLAG,
                 no_builtin: str = NO_BUILTIN_FLAG, projects: DataFrame | None = None) -> DataFrame:
    """T5: per project: has a makefile; some makefile line contains the
    freestanding flag; some contains the no-builtin flag. With ``projects``
    (column ``id``) a project without a makefile has a row of three falses."""
    found = makefile_lines.groupBy(key).agg(
        F.lit(True).alias("has_makefile"),
        F.bool_or(F.col("line").contains(freestanding)).alias("freestanding"),
        F.bool_or(F.col("line").contains(no_builtin)).alias("no_builtin"))
    return _for_all(projects, found, key, dict.fromkeys(("has_makefile", "freestanding", "no_builtin"), F.lit(False)))


def extract_names(docs: DataFrame, text: str, pattern: str = DOC_NAME) -> DataFrame:
    """Distinct matches of ``pattern`` in a document collection."""
    return docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
                       .alias("name")).distinct()
