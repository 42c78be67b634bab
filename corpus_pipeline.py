"""A corpus pipeline: quality rules, near-duplicates, benchmark passages,
secrets, byte-level BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents it keeps, all but the last with the columns of ``docs``.
``run`` writes each stage's result as Parquet to the shared folder and reads
it back as the next stage's input, so a lost executor costs tasks of one stage.

Defined cases: every row is a document of its own, whether or not its doc_id is
null or shared: near-duplicates and contaminated documents are told apart by a
hash of (doc_id, text), so only rows equal in both are one. Of a near-duplicate
group the row of the smallest doc_id stays (null ids last, ties by that hash).
Null, empty and short texts go in the first stage (the base rule asks for 50
words); texts of any length are read whole; columns of ``documents`` that
share a name with a result column of an operator pass through unchanged; empty
tables give empty results.

Byte-level BPE has no SQL form, so ORACLE_SQL is None; tests hold ``run``
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.llm import byte_bpe, decontaminate, near_dedup, quality_rules, secret_scan
from usagelens.llm.common import read_table, to_shared

ORACLE_SQL = None


def _set_aside(docs: DataFrame) -> DataFrame:
    """``text`` beside all columns under names that no operator uses."""
    return docs.select("text", *[F.col(f"`{c}`").alias(f"__doc_{c}") for c in docs.columns])


def _original(columns: list[str]) -> list:
    return [F.col(f"`__doc_{c}`").alias(c) for c in columns]


def _keyed(docs: DataFrame) -> DataFrame:
    """All columns and a key of the row's doc_id and text."""
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and threshold rules (operator 1)."""
    return quality_rules.quality_rules(_set_aside(docs)).where("kept").select(*_original(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (operator 5)."""
    keyed = _keyed(docs)
    judged = near_dedup.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"))
    rows = to_shared(judged.select(F.col("doc_id").alias("__key"), "component_id").distinct().join(
        keyed.groupBy("__key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "__key"), "near-duplicates")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")
    groups = rows.groupBy("component_id").agg(F.min(place).alias("first"), F.sum("n").alias("size")).where("size > 1")
    copies = to_shared(rows.join(groups, "component_id").select(
        "__key", "n", (F.col("__key") == F.col("first.__key")).alias("first")), "near-duplicate-rows")
    only = lambda which, how="left_semi": near_dedup.only_ids(keyed, which.select("__key"), how, "__key")
    return only(copies, "left_anti").unionByName(only(copies.where("first AND n = 1"))) \
        .unionByName(only(copies.where("first AND n > 1")).dropDuplicates(["__key"])).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item (operator 3)."""
    keyed = _keyed(docs)
    found = decontaminate.find_contamination(keyed.select(F.col("__key").alias("doc_id"), "text"),
                                             read_table(spark, sf_dir, "benchmark"))
    hit = to_shared(found.where("n_hit > 0").select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return near_dedup.only_ids(keyed, hit, "left_anti", "__key").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets masked and n_chars counted anew (operator 2)."""
    clean = secret_scan.redact(secret_scan.scan_secrets(_set_aside(docs)))
    columns = dict(zip(docs.columns, _original(docs.columns))) | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size("spans") > 0, F.length("text")).otherwise(columns["n_chars"]) \
            .cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return clean.select(*columns.values())


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and the digests of ids and decoded bytes
    (operator 6); ``ids`` are little-endian unsigned 32-bit integers."""
    return byte_bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), digests=True)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = to_shared(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
