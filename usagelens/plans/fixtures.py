"""Bindings of the driver's test tables to the engine's input schemas.

Each function only shapes columns of the given tables into a study's input
schema (source files, dictionary, projects, commits, diffs, ratings, ...):
renaming, typing, building paths or diff text from document text. None of
them performs an operator's work: scanning, filtering, ranking etc. all
happen in ``usagelens.operators`` on these inputs.
The same bindings are written as SQL in ``plans.oracle`` for the DuckDB check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- FX-USAGE
# Fixed binding parameters (mirrored in plans/oracle.py)
FX_UNKNOWN_PATTERN = "^Th[a-z]"       # identifiers that are usages although unknown
FX_ASM_NAMES = ["the"]               # T4 stand-in for the inline-assembly names
FX_FREESTANDING = "token = "         # T5 stand-ins for the two makefile flags
FX_NO_BUILTIN = "@"
FX_DOC_PATTERN = "<[a-z][a-z0-9]*"   # T6 stand-in for the documented-name pattern
FX_REFERENCE_SOURCE = "src0"         # T2 definitive corpus


@dataclass
class UsageInputs:
    files: DataFrame          # project_id, path, content
    makefiles: DataFrame      # project_id, path, content
    reference_files: DataFrame  # project_id, path, content (definitive corpus)
    term_defs: DataFrame      # name, category, machine_specific, doc_url, header, documented
    excluded_terms: DataFrame  # name, reason
    synonyms: DataFrame       # name, synonym
    projects: DataFrame       # PROJECTS schema subset
    manual_marks: DataFrame   # path: files whose usages were flagged by hand
    pages: DataFrame          # page_id, html


def _project_id(col: str = "source"):
    return F.regexp_extract(F.col(col), "[0-9]+", 0).cast("long")


def files_of(docs: DataFrame) -> DataFrame:
    """documents -> source files (project_id, path, content)."""
    lang_dir = F.when(F.col("lang") == "de", F.lit("gcc-de")).otherwise(F.col("lang"))
    return docs.select(
        _project_id().alias("project_id"),
        F.concat_ws("/", "source", lang_dir, F.concat(F.col("doc_id").cast("string"), F.lit(".c")))
        .alias("path"),
        F.col("text").alias("content"))


def usage_inputs(spark: SparkSession, sf_dir: str) -> UsageInputs:
    docs = read(spark, sf_dir, "documents")
    lang_dir = F.when(F.col("lang") == "de", F.lit("gcc-de")).otherwise(F.col("lang"))
    files = files_of(docs)
    makefiles = docs.select(
        _project_id().alias("project_id"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string"), F.lit("Makefile")).alias("path"),
        F.col("text").alias("content"))
    reference_files = files.where(F.col("path").startswith(FX_REFERENCE_SOURCE + "/"))
    bench = read(spark, sf_dir, "benchmark")
    names = bench.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)))
                         .alias("name")).distinct()
    n = F.length("name")
    term_defs = names.select(
        "name", F.concat(F.lit("len"), n.cast("string")).alias("category"),
        (n % 2 == 1).alias("machine_specific"),
        F.concat(F.lit("https://docs.example.org/len"), n.cast("string")).alias("doc_url"),
        F.concat(F.lit("6."), n.cast("string"), F.lit(" Length "), n.cast("string"),
                 F.lit(" Built-in Functions")).alias("header"),
        (n % 5 != 0).alias("documented"))
    excluded_terms = names.where(n == 3).select("name", F.lit("len3").alias("reason"))
    synonyms = names.select("name", F.when(n <= 4, "short").otherwise("long").alias("synonym"))
    projects = docs.groupBy("source").agg(F.sum("n_chars").cast("long").alias("loc_c")).select(
        _project_id().alias("id"), F.lit("owner").alias("owner"), F.col("source").alias("name"),
        F.concat(F.lit("https://github.com/owner/"), F.col("source")).alias("url"),
        (_project_id() * 7 % 100).cast("int").alias("stars"),
        "loc_c", F.lit(0).cast("long").alias("loc_h"), F.lit(True).alias("processed"))
    manual_marks = docs.where(F.col("doc_id") % 50 == 0).select(
        F.concat_ws("/", "source", lang_dir, F.concat(F.col("doc_id").cast("string"), F.lit(".c")))
        .alias("path"))
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    return UsageInputs(files, makefiles, reference_files, term_defs, excluded_terms, synonyms,
                       projects, manual_marks, pages)


def file_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 input: one unified diff per document. doc_id % 3 = 0 is an added
    file, 1 a deleted file, 2 a modified file whose odd lines are additions
    and even lines deletions; each diff is one hunk behind its file headers."""
    docs = read(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "ADD").when(F.col("doc_id") % 3 == 1, "DELETE") \
        .otherwise("MODIFY")
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".c")))
    old_path = F.when(F.col("doc_id") % 10 == 4, F.regexp_replace(path, r"\.c$", ".cpp")).otherwise(path)
    lines = F.split("text", "\n")
    body = F.array_join(F.transform(lines, lambda l, i: F.concat(
        F.when((kind == "ADD") | ((kind == "MODIFY") & (i % 2 == 0)), F.lit("+")).otherwise(F.lit("-")), l)), "\n")
    header = F.concat(F.lit("--- a/"), old_path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1 +1 @@\n"))
    return docs.select(_project_id().alias("project_id"), F.col("doc_id").cast("string").alias("hash"),
                       kind.alias("change_type"), old_path.alias("old_path"), path.alias("new_path"),
                       F.concat(header, body).alias("diff"))


def snapshot_versions(spark: SparkSession, sf_dir: str):
    """H2 input: two versions of file ``doc_id div 2``: the even document is
    the old content, the odd one the new content."""
    docs = read(spark, sf_dir, "documents")
    f = docs.select(_project_id().alias("project_id"), (F.col("doc_id") / 2).cast("long").alias("file_key"),
                    F.col("doc_id"), F.col("text").alias("content"))
    return (f.where(F.col("doc_id") % 2 == 0).drop("doc_id"), f.where(F.col("doc_id") % 2 == 1).drop("doc_id"))


# ---------------------------------------------------------------- FX-NEED
def needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, term_id, name, category, machine_specific): which term each
    project needs. project = order, term = part brand, through its lines."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brand_nr = F.substring("p_brand", 7, 10).cast("int")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.col("l_orderkey").alias("project_id"), "p_brand").distinct()
            .select("project_id", brand_nr.cast("long").alias("term_id"),
                    F.col("p_brand").alias("name"),
                    F.when(brand_nr % 5 == 0, "libc").otherwise("other").alias("category"),
                    (brand_nr % 2 == 0).alias("machine_specific")))


# ---------------------------------------------------------------- FX-HISTORY
@dataclass
class HistoryInputs:
    commits: DataFrame   # project_id, hash, message, ts_unix, author, email, commit_nr
    deltas: DataFrame    # hash, project_id, delta
    projects: DataFrame  # id, name, owner, first_commit, last_commit, history_checked
    ratings: DataFrame   # project_id, label, user


# Fixed binding: signed term change per event type (click counts 0, view none)
FX_DELTA = {"purchase": 3, "signup": 1, "error": -2, "click": 0}


def _event_hash():
    """Commit hash stand-in: the event id, zero-padded so that string order
    is id order (the fixture's tie order)."""
    return F.lpad(F.col("event_id").cast("string"), 12, "0")


def deltas_of(ev: DataFrame) -> DataFrame:
    """events -> commit deltas (hash, project_id, delta); views carry none."""
    delta = F.lit(None).cast("int")
    for k, v in FX_DELTA.items():
        delta = F.when(F.col("event_type") == k, F.lit(v)).otherwise(delta)
    return ev.select(_event_hash().alias("hash"), F.col("user_id").alias("project_id"),
                     delta.alias("delta")).where(F.col("delta").isNotNull())


def history_inputs(spark: SparkSession, sf_dir: str) -> HistoryInputs:
    ev = read(spark, sf_dir, "events")
    ts = F.unix_timestamp("ts")
    commits = ev.select(
        F.col("user_id").alias("project_id"), _event_hash().alias("hash"),
        F.concat(F.col("event_type"), F.lit("\nvalue "), F.col("value").cast("string")).alias("message"),
        ts.alias("ts_unix"), F.col("event_type").alias("author"),
        F.concat(F.col("event_type"), F.lit("@example.org")).alias("email"))
    deltas = deltas_of(ev)
    projects = ev.groupBy("user_id").agg(F.min("ts").alias("f"), F.max("ts").alias("l")).select(
        F.col("user_id").alias("id"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("name"),
        F.lit("owner").alias("owner"), F.to_date("f").alias("first_commit"),
        F.to_date("l").alias("last_commit"), (F.col("user_id") % 7 != 0).alias("history_checked"))
    ratings = ev.select("user_id").distinct().select(
        F.col("user_id").alias("project_id"),
        F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("label"),
        F.lit("rater").alias("user"))
    return HistoryInputs(commits, deltas, projects, ratings)


# ---------------------------------------------------------------- FX-RATING
RESOLVER_RATER = "7"
AUTOMATIC_RATER = "1"
MASS_RATER = "2"
RATING_FAMILIES = {"increasing": ["A"], "stagnant": ["R"]}


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, user, label, _seq): item = order, rater = line number,
    label = return flag. Repeated (order, line) pairs: the row with the
    highest (part key, flag) is the last writer."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("project_id"),
                     F.col("l_linenumber").cast("string").alias("user"),
                     F.col("l_returnflag").alias("label"),
                     F.struct("l_partkey", "l_returnflag").alias("_seq"))


# ---------------------------------------------------------------- FX-COVER
COVER_NUMERIC = ["p_size", "p_retailprice"]
COVER_FACTOR = ["p_type", "p_brand"]


def cover_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("repository"), *COVER_NUMERIC, *COVER_FACTOR)


def cover_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_universe(spark, sf_dir).where(F.col("repository") % 10 == 0)


# ---------------------------------------------------------------- FX-PROJECT
def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PROJECTS-shaped table: project = customer key over its orders."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("long").alias("loc_c"), F.count("*").cast("int").alias("commits"),
        F.countDistinct("o_orderpriority").cast("int").alias("committers"),
        F.to_date(F.min("o_orderdate")).alias("first_commit"),
        F.to_date(F.max("o_orderdate")).alias("last_commit")).select(
        F.col("o_custkey").alias("id"), F.lit("owner").alias("owner"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"),
        F.concat(F.lit("https://github.com/owner/c"), F.col("o_custkey").cast("string")).alias("url"),
        (F.col("o_custkey") % 100).cast("int").alias("stars"),
        "loc_c", F.lit(0).cast("long").alias("loc_h"), "commits", "committers",
        "first_commit", "last_commit", (F.col("o_custkey") % 7 != 0).alias("processed"))


# ---------------------------------------------------------------- FX-CHAIN
def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_id, hash, parent): commit = order key, parent = key div 2
    (key 0 is the root)."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.lit(1).cast("long").alias("project_id"), F.col("o_orderkey").alias("hash"),
                    F.when(F.col("o_orderkey") > 0, F.floor(F.col("o_orderkey") / 2))
                    .cast("long").alias("parent"))
