"""Incremental work N1-N3 on Structured Streaming.

The study kept per-project flags ("processed", "history checked") to resume
work; here the streaming checkpoint plays that role: every input file is
processed exactly once, a restarted query continues where it stopped, and
the sinks are idempotent per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exclude, scan, tables
from ..sources.files import explode_lines


def scan_incremental(spark: SparkSession, source_dir: str, schema, to_files: Callable[[DataFrame], DataFrame],
                     terms: DataFrame, sink: str, checkpoint: str, glob: str | None = None,
                     max_files_per_trigger: int | None = None, unknown_pattern: str | None = None) -> None:
    """Scan only the files that arrived since the last run (the file
    source's checkpoint remembers them) and append their usages to a
    Parquet sink. The scan is stateless (explode + join), so each micro-batch
    is independent; ``availableNow`` processes everything new and stops.

    Names that only match ``unknown_pattern`` are stored with a NULL id; see
    ``read_usages``."""
    reader = spark.readStream.schema(schema).format("parquet")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    files = to_files(reader.load(source_dir))
    usages = scan.scan_terms(explode_lines(files), terms, unknown_pattern) \
        .select("project_id", "path", "line_nr", "term", "term_id")
    q = (usages.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def scan_growing(spark: SparkSession, source_dir: str, schema, to_files: Callable[[DataFrame], DataFrame],
                 terms: DataFrame, sink: str, dictionary: str, checkpoint: str,
                 unknown_pattern: str = scan.UNKNOWN_PATTERN, defaults: dict | None = None,
                 glob: str | None = None, max_files_per_trigger: int | None = None) -> None:
    """N1 with K8: as ``scan_incremental``, and the dictionary grows with the
    batches. Each micro-batch writes its usages (line text, line hash and flags,
    so exclusion can run on them) and the names it saw first to folders of its
    own, see ``scan_batch``. ``terms`` is the dictionary of the first run,
    unchanged in later ones; ``read_dictionary`` and ``read_usages`` give both
    as they stand."""
    reader = spark.readStream.schema(schema).format("parquet")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))

    def write(batch: DataFrame, batch_id: int) -> None:
        scan_batch(batch, batch_id, terms, sink, dictionary, unknown_pattern, defaults or {})

    q = (to_files(reader.load(source_dir)).writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def scan_batch(files: DataFrame, batch_id: int, terms: DataFrame, sink: str, dictionary: str,
               unknown_pattern: str, defaults: dict) -> None:
    """One micro-batch of ``scan_growing``, the text read and tokenised once.

    Known names are the entries of *earlier* batches, and new ids follow from
    those and the batch's names alone: a batch that is run again overwrites its
    folders with the same rows and ids. Usages of names first seen in this
    batch are stored without an id; readers join it."""
    spark = files.sparkSession
    known = read_dictionary(spark, terms, dictionary, batch_id)
    lines = exclude.line_flags(explode_lines(files))
    out = f"{sink}/batch_id={batch_id}"
    scan.scan_terms(lines, known, unknown_pattern).write.mode("overwrite").parquet(out)
    added = tables.new_entries(known, scan.unknown_terms(spark.read.parquet(out)), defaults)
    added.write.mode("overwrite").parquet(f"{dictionary}/batch_id={batch_id}")


def read_dictionary(spark: SparkSession, terms: DataFrame, dictionary: str,
                    before: int | None = None) -> DataFrame:
    """K8: ``terms`` and the entries that the batches of ``scan_growing`` added
    (those with an id below ``before`` only). Batch ids start at 0."""
    if before == 0:
        return terms
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in terms.schema.fields)
    log = spark.read.schema(f"{schema}, batch_id long").parquet(dictionary)
    if before is not None:
        log = log.where(F.col("batch_id") < before)
    return terms.unionByName(log.drop("batch_id"))


def history_incremental(spark: SparkSession, source_dir: str, schema,
                        to_deltas: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
                        glob: str | None = None, max_files_per_trigger: int | None = None) -> None:
    """Per micro-batch, the net change per commit of the new records, in a
    folder of its own (``batch_id=``). A batch that is run again after a
    failure overwrites its folder only, so no other batch loses or repeats
    rows; ``read_history`` adds the batches up."""
    reader = spark.readStream.schema(schema).format("parquet")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    deltas = to_deltas(reader.load(source_dir))

    def write(batch: DataFrame, batch_id: int) -> None:
        net = batch.groupBy("project_id", "hash").agg(F.sum("delta").cast("long").alias("net"))
        net.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    q = (deltas.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_history(spark: SparkSession, sink: str) -> DataFrame:
    """(project_id, hash, net) over all batches of ``history_incremental``;
    a commit's records may have come in several batches."""
    return spark.read.parquet(sink).groupBy("project_id", "hash").agg(F.sum("net").cast("long").alias("net"))


def read_usages(spark: SparkSession, sink: str, terms: DataFrame) -> DataFrame:
    """Usages of ``scan_incremental``; names that were unknown when they
    were scanned get their id from the extended dictionary."""
    return scan.resolve_term_ids(spark.read.parquet(sink), terms)


def refresh_views(views: dict, order: list[str]) -> dict:
    """After ingestion, recompute the persisted views in dependency
    order (K3)."""
    from ..sources.sinks import materialise_all
    return materialise_all(views, order)
