"""False-positive removal T7-T14 and the filtered usage view.

Lines are long strings and a line is repeated by every usage on it, so usages
and fragments hold a digest of the line (``line_key``); the text is joined to
the fragments only where it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import anti, broadcast_checked
from .scan import UNKNOWN_CATEGORY

# Directory-name prefixes of vendored compiler sources.
VENDORED_DIRS = ["gcc", "llvm", "clang"]
# Project filter (names of compiler projects, minimum C LOC).
DENIED_PROJECTS = ["gcc", "gcc-xtensa", "gccxml", "rose"]
MIN_LOC = 100
# Exclusion categories, in rule order (earlier rule wins).
COMMENT, QUOTES, MANUAL = "COMMENT", "QUOTES", "MANUAL"


def in_vendored_dir(path) -> Column:
    """Some directory component starts with a compiler name
    (ASCII case-insensitive LIKE '%/gcc%/%')."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for d in VENDORED_DIRS:
        out = out | p.ilike(f"%/{d}%/%")
    return out


def line_key(line: Column) -> Column:
    """The first 128 bits of the line's SHA-256: equal for equal texts only."""
    return F.substring(F.unhex(F.sha2(line, 256)), 1, 16)


def line_flags(lines: DataFrame) -> DataFrame:
    """Per-line attributes computed once per line (before the token explode
    of the scan multiplies the line by its number of usages): the hash key of
    the line text, the vendored-directory flag of its file and whether the
    line carries a comment / quote marker at all."""
    return lines.withColumn("line_hash", F.xxhash64("line")) \
        .withColumn("vendored", in_vendored_dir("path")) \
        .withColumn("marker", may_be_fragment(F.col("line")))


def fragment_category(line: Column, name: Column) -> Column:
    """T7 rules for one (line, name); NULL when the usage is real code.

    COMMENT: ``//`` somewhere before the name; or ``/*`` followed by the name
    with no ``*`` in between; or the line starts with ``[ \\t]*\\* ``.
    QUOTES: a double quote before and after the name. Earlier rule wins.

    Names are identifiers (no ``*``, no quote), so the rules reduce to
    literal searches -- no regular expression is compiled per row:

    * ``//`` rule: the name occurs at or after the first ``//`` + 2;
    * ``/*`` rule: for some ``/*``, the text up to the next ``*`` contains
      the name;
    * quote rule: after the first quote the name occurs, and a quote follows
      that first occurrence.
    """
    def locate(sub, pos):
        return F.call_function("locate", sub if isinstance(sub, Column) else F.lit(sub), line, pos)

    slash = locate("//", F.lit(1))
    c1 = (slash > 0) & (locate(name, slash + 2) > 0)
    after_open = F.split(line, "/\\*")
    c2 = F.exists(F.slice(after_open, 2, F.size(after_open)),
                  lambda seg: F.substring_index(seg, "*", 1).contains(name))
    c3 = line.rlike("^[ \t]*\\* ")
    quote = locate('"', F.lit(1))
    at = locate(name, quote + 1)
    q = (quote > 0) & (at > 0) & (locate('"', at + F.length(name)) > 0)
    return F.when(c1 | c2 | c3, F.lit(COMMENT)).when(q, F.lit(QUOTES))


def may_be_fragment(line: Column) -> Column:
    """Cheap necessary condition of the T7 rules (comment or quote marker)."""
    return (line.contains("//") | line.contains("/*") | line.contains('"')
            | line.rlike("^[ \t]*\\* "))


def classify_fragments(usages: DataFrame, terms: DataFrame) -> DataFrame:
    """(line, term_id, category) for every distinct (line, term) outside
    vendored directories that lies in a comment or a string.

    The category depends on (line, name) only, so it is evaluated where the
    usage is stored (no shuffle of the long lines), and only on lines that
    carry a marker at all (flag computed once per line by the scan); only the
    few classified rows are de-duplicated.
    """
    names = broadcast_checked(terms.select(F.col("id").alias("term_id"), F.col("name")))
    cand = usages.where(~F.col("vendored") & F.col("marker")).select("line", "term_id")
    return (cand.join(names, "term_id")
            .select("line", "term_id", fragment_category(F.col("line"), F.col("name")).alias("category"))
            .where(F.col("category").isNotNull())
            .dropDuplicates(["line", "term_id"]))


def fragments_from_scan(usages: DataFrame) -> DataFrame:
    """T7 when the scan already attached ``auto_category`` to each usage
    (``fragment_category`` evaluated on marker lines outside vendored
    directories): the distinct classified (line_key, term_id, category)."""
    return (usages.where(F.col("auto_category").isNotNull())
            .select("line_key", "term_id", F.col("auto_category").alias("category")).distinct())


def with_lines(fragments: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, term_id, category) of fragments; ``lines`` (line) holds the text
    of every fragment, in any number of copies."""
    texts = lines.select(line_key(F.col("line")).alias("line_key"), "line") \
        .join(fragments.select("line_key").distinct(), "line_key", "left_semi").distinct()
    return fragments.join(texts, "line_key").select("line", "term_id", "category")


# Sets of 64-bit line hashes are broadcast up to this many, fragments up to these bytes.
MAX_BROADCAST_LINES = 1_000_000
FRAGMENT_BROADCAST_BYTES = 16 << 20


def _line_hashes(df: DataFrame) -> DataFrame:
    return df.select(F.xxhash64("line_key").alias("_m")).distinct()


def _few(hashes: DataFrame) -> bool:
    return hashes.limit(MAX_BROADCAST_LINES + 1).count() <= MAX_BROADCAST_LINES


def sync_manual(usages: DataFrame, auto: DataFrame) -> DataFrame:
    """The full fragment table (line_key, term_id, category) from the
    automatic fragments and the usages flagged by hand (``excluded``):

    * a flagged (line, term) not listed yet becomes MANUAL;
    * a MANUAL line also found automatically is dropped;
    * fragments whose line occurs only in vendored directories are dropped.

    Automatic fragments come from usages outside vendored directories, so
    they are live by construction; a manual fragment is live when one of its
    own flagged usages is outside them. Only the remaining manual lines are
    probed against the lines of all usages; if they are few, a broadcast of
    their hashes leaves out the others before the shuffle.
    """
    flagged = usages.where(F.col("excluded")).groupBy("line_key", "term_id") \
        .agg(F.bool_or(~F.col("vendored")).alias("_live"))
    # a pair listed automatically is on a line found automatically
    manual = flagged.join(auto.select("line_key").distinct(), "line_key", "left_anti") \
        .withColumn("category", F.lit(MANUAL))
    sure = manual.where(F.col("_live")).drop("_live")
    unsure = manual.where(~F.col("_live")).drop("_live")
    outside = usages.where(~F.col("vendored")).select("line_key")
    hashes = _line_hashes(unsure)
    if _few(hashes):
        outside = outside.join(F.broadcast(hashes), F.xxhash64("line_key") == F.col("_m"), "left_semi")
    probed = unsure.join(outside.distinct(), "line_key", "left_semi")
    return auto.unionByName(sure).unionByName(probed)


# Fragment categories in rule order: the first one of a line (and term) counts.
RULE_ORDER = [COMMENT, QUOTES, MANUAL]


def listed(usages: DataFrame, fragments: DataFrame, by_term: bool) -> DataFrame:
    """``usages`` with ``_cat``: the category of the fragment on the usage's
    line (and term), NULL if there is none.

    If the fragments are too many to broadcast, only usages that can be listed
    are shuffled: automatic fragments are on lines with a ``marker``, and the
    lines of manual ones are told by a broadcast of their hashes, if few.
    """
    keys = ["line_key", "term_id"] if by_term else ["line_key"]
    place = F.lit(len(RULE_ORDER) - 1)
    for i, c in reversed(list(enumerate(RULE_ORDER))):
        place = F.when(F.col("category") == c, F.lit(i)).otherwise(place)
    side = fragments.groupBy(*keys).agg(F.min(place).alias("_place"))
    side = side.select(*keys, F.element_at(F.array(*map(F.lit, RULE_ORDER)), F.col("_place") + 1).alias("_cat"))
    small = broadcast_checked(side, FRAGMENT_BROADCAST_BYTES)
    columns = [*usages.columns, "_cat"]
    if small is not side:
        return usages.join(small, keys, "left").select(*columns)
    hashes = _line_hashes(fragments.where(F.col("category") == MANUAL))
    if not _few(hashes):
        return usages.join(side, keys, "left").select(*columns)
    told = usages.join(F.broadcast(hashes), F.xxhash64("line_key") == F.col("_m"), "left")
    can_be = F.col("marker") | F.col("_m").isNotNull()
    rest = told.where(~can_be).withColumn("_cat", F.lit(None).cast("string"))
    return told.where(can_be).join(side, keys, "left").select(*columns).unionByName(rest.select(*columns))


def mark_excluded(usages: DataFrame, fragments: DataFrame, by_term: bool = True) -> DataFrame:
    """``excluded`` := flagged by hand OR the usage's line is listed.

    ``by_term=True`` matches (line, term); ``by_term=False`` reproduces the
    study, where a listed line excludes every term on it.
    """
    out = listed(usages, fragments, by_term)
    return out.withColumn("excluded", F.coalesce(F.col("excluded"), F.lit(False)) | F.col("_cat").isNotNull()) \
        .select(*usages.columns)


def project_filter(projects: DataFrame, min_loc: int = MIN_LOC,
                   denied: list[str] = DENIED_PROJECTS) -> DataFrame:
    """Processed, at least ``min_loc`` lines of C (C + headers), not a
    compiler project; adds ``loc``."""
    loc = F.coalesce(F.col("loc_c"), F.lit(0)) + F.coalesce(F.col("loc_h"), F.lit(0))
    return (projects.withColumn("loc", loc.cast("long"))
            .where(F.col("processed") & (F.col("loc") >= min_loc) & ~F.col("name").isin(*denied)))


def term_filter(terms: DataFrame, excluded_terms: DataFrame) -> DataFrame:
    """The studied terms: neither excluded by name nor of unknown origin."""
    return anti(terms, excluded_terms.select("name"), "name") \
        .where(~F.col("category").eqNullSafe(UNKNOWN_CATEGORY))


def kept_usages(usages: DataFrame) -> DataFrame:
    """Usages outside vendored directories that are not excluded."""
    return usages.where(~F.col("vendored") & ~F.col("excluded")) \
        .select("project_id", "path", "line_nr", "term_id")


def with_attributes(kept: DataFrame, projects: DataFrame, terms: DataFrame) -> DataFrame:
    """Usages of studied projects and terms with their attributes (loc, url,
    name, category, machine_specific, documented)."""
    p = broadcast_checked(projects.select(F.col("id").alias("project_id"), "loc", "url",
                                          F.col("name").alias("project_name")))
    t = broadcast_checked(terms.select(F.col("id").alias("term_id"), F.col("name").alias("term_name"),
                                       "category", "machine_specific", "documented", "header"))
    return kept.join(p, "project_id").join(t, "term_id")


def filtered_usages(usages: DataFrame, projects: DataFrame, terms: DataFrame) -> DataFrame:
    """Usages of studied projects and terms, outside vendored
    directories, not excluded. ``projects`` / ``terms`` are the filtered
    dimensions (``project_filter`` / ``term_filter``)."""
    return with_attributes(kept_usages(usages), projects, terms)


def exclusion_shares(usages_raw: DataFrame, fragments: DataFrame, projects: DataFrame,
                     terms: DataFrame, by_term: bool = True) -> DataFrame:
    """Share of raw usages removed per reason and kept, one reason per
    usage (first of: project, term, vendored, comment, quotes, manual),
    so the shares and the kept share add up to 100 %.

    One pass over the usages with conditional counts.
    """
    pk = broadcast_checked(projects.select(F.col("id").alias("project_id")).withColumn("_p", F.lit(True)))
    tk = broadcast_checked(terms.select(F.col("id").alias("term_id")).withColumn("_t", F.lit(True)))
    u = (listed(usages_raw, fragments, by_term)
         .join(pk, "project_id", "left").join(tk, "term_id", "left"))
    reason = (F.when(F.col("_p").isNull(), "project").when(F.col("_t").isNull(), "term")
              .when(F.col("vendored"), "vendored")
              .when(F.col("_cat") == COMMENT, "comment").when(F.col("_cat") == QUOTES, "quotes")
              .when((F.col("_cat") == MANUAL) | F.col("excluded"), "manual")
              .otherwise("kept"))
    u = u.withColumn("reason", reason)
    total = F.count("*")
    aggs = [F.count("*").alias("nr_raw")]
    for r in ["project", "term", "vendored", "comment", "quotes", "manual", "kept"]:
        aggs.append(F.count_if(F.col("reason") == r).alias(f"nr_{r}"))
        aggs.append(F.round(F.try_divide(F.count_if(F.col("reason") == r) * 100.0, total), 6).alias(f"pct_{r}"))
    return u.agg(*aggs)


def rare_undocumented(usages: DataFrame, terms: DataFrame) -> DataFrame:
    """Number of undocumented terms used in at most one project (a term
    never used has a NULL count and is *not* counted)."""
    per_term = usages.groupBy("term_id").agg(F.countDistinct("project_id").alias("n"))
    t = terms.where(~F.col("documented")).select(F.col("id").alias("term_id"))
    return t.join(per_term, "term_id", "left").agg(F.count_if(F.col("n") <= 1).alias("nr_rare"))
