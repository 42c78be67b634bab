"""Sources S1-S11: file trees, definition files, delimited files, JSON pages,
version-control statistics and LOC reports, all read as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines

# Which files of a project tree are scanned.
SOURCE_SUFFIXES = (".c", ".h")
MAKEFILE_NAME = "makefile"


def _decode(content) -> F.Column:
    """Bytes -> string; malformed UTF-8 becomes U+FFFD instead of failing."""
    return F.make_valid_utf8(content.cast("string"))


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(project, path, content, is_makefile) of every C source, header
    and makefile below ``root``; project = first directory below the root,
    path relative to the root (so it starts with the project directory).

    The file listing only keeps the wanted names, so the content of other
    files is never opened; a file that cannot be read fails the scan.
    """
    root = root.rstrip("/")
    raw = (spark.read.format("binaryFile")
           .option("recursiveFileLookup", "true")
           .option("ignoreMissingFiles", "true")
           .option("pathGlobFilter", "{*.[cChH],[mM][aA][kK][eE][fF][iI][lL][eE]}")
           .load(root))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    keep = F.lit(False)
    for suf in SOURCE_SUFFIXES:
        keep = keep | name.endswith(suf)
    keep = keep | (name == MAKEFILE_NAME)
    rel = F.regexp_extract("path", r"^(?:file:)?/*" + _escape(root.lstrip("/")) + "/(.*)$", 1)
    return (raw.where(keep)
            .select(F.element_at(F.split(rel, "/"), 1).alias("project"),
                    rel.alias("path"),
                    _decode(F.col("content")).alias("content"),
                    (name == MAKEFILE_NAME).alias("is_makefile")))


def _escape(s: str) -> str:
    import re
    return re.escape(s)


# A task reads about this much of an input that arrives in larger files.
TASK_BYTES, LARGE_FILE_BYTES = 16 << 20, 64 << 20


def balance(df: DataFrame, factor: int = 2) -> DataFrame:
    """Spread rows of an input that arrives as fewer files than the cluster
    has task slots (e.g. one large file), or as large files, over ``factor`` x
    the default parallelism and at least one task per ``TASK_BYTES``, so that a
    task after it holds a bounded part. The rows are dealt by a hash of all
    their columns (round-robin would sort each task's rows first). With many
    files of moderate size nothing is shuffled."""
    sc = df.sparkSession.sparkContext
    slots = sc.defaultParallelism
    files = df.inputFiles()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if files and (len(files) < slots or size > len(files) * LARGE_FILE_BYTES):
        return df.repartition(max(slots * factor, -(-size // TASK_BYTES)), *df.columns)
    return df


def explode_lines(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """One row per line: (..., line_nr 1-based, line). CRLF, LF and CR end
    a line; a final terminator makes no extra line."""
    keep = keep if keep is not None else [c for c in df.columns if c != content]
    return df.select(*keep, F.posexplode(split_lines(content)).alias("pos", "line")) \
        .select(*keep, (F.col("pos") + 1).cast("int").alias("line_nr"), "line")


def _read_text_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    return (spark.read.option("wholetext", "true")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*" + suffix)
            .text(root)
            .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")))


class DefinitionError(ValueError):
    """Raised when definition files violate their format."""


def parse_definitions(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3 core on (file, content): returns (terms, violations).

    Format: ``#`` comment lines; ``%url=`` / ``%header=`` set the attributes
    of the names that follow; every other line is a name. The category is the
    file's base name without ``.def``; names in a path containing
    ``architecture-specific`` are machine specific.
    """
    lines = explode_lines(files, "content", ["file"])
    base = F.element_at(F.split("file", "/"), -1)
    lines = lines.withColumn("category", F.regexp_replace(base, r"\.def$", ""))
    is_attr = F.col("line").startswith("%")
    key = F.regexp_extract("line", r"^%([^=]*)=", 1)
    val = F.regexp_extract("line", r"^%[^=]*=(.*)$", 1)
    w = Window.partitionBy("file").orderBy("line_nr").rowsBetween(Window.unboundedPreceding, 0)
    lines = (lines
             .withColumn("kind", F.when(F.col("line").startswith("#"), "comment")
                         .when(is_attr, "attr").otherwise("name"))
             .withColumn("url", F.last(F.when(is_attr & (key == "url"), val), True).over(w))
             .withColumn("header", F.last(F.when(is_attr & (key == "header"), val), True).over(w)))
    names = lines.where(F.col("kind") == "name")
    dup = names.groupBy(F.col("line").alias("name")).agg(F.count("*").alias("n")).where("n > 1")
    violations = (
        lines.where((F.col("kind") == "attr") & ~key.isin("url", "header"))
        .select("file", "line_nr", F.concat(F.col("line"), F.lit(" is unknown")).alias("problem"))
        .unionByName(names.where(F.col("url").isNull()).select(
            "file", "line_nr", F.lit("url not defined").alias("problem")))
        .unionByName(names.where(F.col("header").isNull()).select(
            "file", "line_nr", F.lit("header not defined").alias("problem")))
        .unionByName(names.join(dup, names.line == dup.name, "left_semi").select(
            "file", "line_nr", F.concat(F.lit("duplicate "), F.col("line")).alias("problem"))))
    terms = names.select(
        F.col("line").alias("name"), "category",
        F.col("file").contains("architecture-specific").alias("machine_specific"),
        F.col("url").alias("doc_url"), "header", F.lit(True).alias("documented"))
    return terms, violations


def read_term_definitions(spark: SparkSession, root: str) -> DataFrame:
    """S3: all ``*.def`` files below ``root`` as a terms table (without ids;
    see ``operators.tables.extend_dictionary``). Raises on a format violation."""
    terms, violations = parse_definitions(_read_text_files(spark, root, ".def"))
    bad = violations.limit(20).collect()
    if bad:
        raise DefinitionError("; ".join(f"{r.file}:{r.line_nr}: {r.problem}" for r in bad))
    return terms


def parse_exclusions(files: DataFrame) -> DataFrame:
    """S4 core on (file, content): (name, reason = file base name)."""
    lines = explode_lines(files, "content", ["file"])
    base = F.element_at(F.split("file", "/"), -1)
    return (lines.where(~F.col("line").startswith("#") & (F.col("line") != ""))
            .select(F.col("line").alias("name"),
                    F.regexp_replace(base, r"\.def$", "").alias("reason")))


def read_exclusions(spark: SparkSession, root: str) -> DataFrame:
    """Excluded names, one per line of every ``*.def`` file below root."""
    return parse_exclusions(_read_text_files(spark, root, ".def"))


def parse_key_value(lines: DataFrame, line: str = "line",
                    key: str = "name", value: str = "synonym") -> DataFrame:
    """``name=value`` lines -> (name, value); blank lines skipped."""
    l = F.col(line)
    return (lines.where(l.contains("="))
            .select(F.substring_index(l, "=", 1).alias(key),
                    F.element_at(F.split(l, "="), 2).alias(value)))


def read_key_value(spark: SparkSession, path: str, key: str = "name",
                   value: str = "synonym") -> DataFrame:
    """A key=value text file as a two-column table."""
    return parse_key_value(spark.read.text(path).withColumnRenamed("value", "line"),
                           "line", key, value)


def read_delimited(spark: SparkSession, path: str, sep: str = ";", schema=None) -> DataFrame:
    """Header CSV with ',' or ';'; a schema avoids inference at scale."""
    r = spark.read.option("header", "true").option("sep", sep)
    return r.schema(schema).csv(path) if schema is not None else \
        r.option("inferSchema", "true").csv(path)


def read_delimited_glob(spark: SparkSession, pattern: str, sep: str = ";", schema=None,
                        source_col: str = "source") -> DataFrame:
    """Many same-schema delimited files, with the file's base name
    (without extension) as a column."""
    df = read_delimited(spark, pattern, sep, schema)
    base = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.withColumn(source_col, F.regexp_replace(base, r"\.[^.]*$", ""))


def read_project_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Stored search-result pages (JSON with ``items[]``) -> one row per
    repository."""
    pages = spark.read.option("multiLine", "true").json(path)
    return project_metadata(pages)


def project_metadata(pages: DataFrame) -> DataFrame:
    """S8 core: explode ``items`` and pick the repository attributes."""
    it = pages.select(F.explode("items").alias("i"))
    return it.select(
        F.col("i.owner.login").alias("owner"), F.col("i.name").alias("name"),
        F.col("i.html_url").alias("url"), F.col("i.stargazers_count").cast("int").alias("stars"),
        F.col("i.forks_count").cast("int").alias("forks"),
        F.col("i.open_issues_count").cast("int").alias("open_issues"),
        F.col("i.watchers_count").cast("int").alias("watchers"),
        F.col("i.fork").cast("boolean").alias("fork"),
        F.to_timestamp(F.col("i.created_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.col("i.language").alias("language"), F.col("i.description").alias("description"))


def project_vcs_stats(commits: DataFrame) -> DataFrame:
    """Per project: non-merge commits, distinct authors, first / last
    commit time and the head hash (newest commit; ties -> larger hash).

    One partial aggregation per project: a project holding a third of all
    commits still combines map-side first.
    """
    return commits.groupBy("project_id").agg(
        F.count_if(F.coalesce(F.size("parents"), F.lit(0)) <= 1).alias("commits"),
        F.countDistinct("author").alias("committers"),
        F.min("ts_unix").alias("first_ts"), F.max("ts_unix").alias("last_ts"),
        F.max_by("hash", F.struct("ts_unix", "hash")).alias("head_hash"))


# Language rows of the LOC report; the LOC is the 4th number
# (files, blank, comment, code).
LOC_ROWS = {
    "loc_c": r"C\s+\d+\s+\d+\s+\d+\s+(\d+)",
    "loc_h": r"C/C\+\+\sHeader\s+\d+\s+\d+\s+\d+\s+(\d+)",
    "loc_cpp": r"C\+\+\s+\d+\s+\d+\s+\d+\s+(\d+)",
    "loc_asm": r"Assembly\s+\d+\s+\d+\s+\d+\s+(\d+)",
}


def loc_report(reports: DataFrame, report: str = "report", key: str = "project_id") -> DataFrame:
    """LOC per language from a LOC report text; a missing language is 0.
    The last matching line of a report wins."""
    lines = explode_lines(reports.select(key, report), report, [key])
    aggs = []
    for col, pat in LOC_ROWS.items():
        m = F.regexp_extract("line", "^" + pat, 1)
        aggs.append(F.coalesce(F.max_by(F.when(m != "", m.cast("long")),
                                        F.when(m != "", F.col("line_nr"))),
                               F.lit(0)).cast("long").alias(col))
    return lines.groupBy(key).agg(*aggs)


def table(spark: SparkSession, location: str) -> DataFrame:
    """A table by name (catalog) or by Parquet location."""
    if "/" in location:
        return spark.read.parquet(location)
    return spark.table(location)
