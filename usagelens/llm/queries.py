"""The registered query of each operator: opN_<name>(spark, sf_dir).

Every query applies its operator with production parameters to the whole
table and derives the digest columns of its contract from the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (byte_bpe, decontaminate, language_id, near_dedup, phrase_mining, quality_classifier,
               secret_scan, spelling_variants, substring_dedup, token_output, topk_search, url_filter)
from . import quality_rules as quality
from .common import read_table, to_shared

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over every whole text of ``documents``."""
    out = quality.quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words",
                      F.array_join("failed_rules", ",").alias("failed_rules"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    names, out = secret_scan.kinds(), secret_scan.scan_secrets(docs)
    counts = [secret_scan.count_kind("base_spans", k).alias(f"n_{n}")
              for k, n in enumerate(names[:len(secret_scan.BASE)])]
    return out.select(
        "doc_id", *counts,
        F.sha2(secret_scan.spans_text(F.col("base_spans"), names), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans"), names).alias("spans"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ``benchmark`` items in every whole text of ``documents``;
    ``near_items`` adds matches with each word up to two places off."""
    found = decontaminate.find_contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), slop=2)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"),
                        F.size("near_items").cast("long").alias("n_near_items"))


@query
def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text of ``documents``, written as one ordered
    binary stream and read back."""
    stream = token_output.write_stream(read_table(spark, sf_dir, "documents"))
    return token_output.document_digests(stream)


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over every whole text of ``documents``."""
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text of ``documents``, decoded again."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_texts(docs, digests=True, keep_ids=False)


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller document of ``documents`` holds."""
    out = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from the
    documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", "text"), model)


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``; a document's source is
    its host and its lang the section beneath, as the table has no url."""
    return quality_classifier.quality_scores(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
        keep_evidence=lambda df: to_shared(df, "quality-evidence"))


# Fixed rules of the task (action, host, path).
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every url of ``pages``."""
    out = url_filter.judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query
def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other rows of every vector of ``embeddings`` whose id is
    divisible by 50, by integer inner product."""
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings"), every=50, k=5)


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of every whole text of ``documents``."""
    return spelling_variants.spelling_variants(read_table(spark, sf_dir, "documents"))


@query
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations in the whole texts of
    ``documents``."""
    return phrase_mining.collocations(read_table(spark, sf_dir, "documents"))
