import os

from pyspark.sql import functions as F

from usagelens.operators import exclude, ratings, scan
from usagelens.sources.files import explode_lines
from usagelens.sources.sinks import project_key, write_delimited, write_series_per_project
from usagelens.streaming import incremental

SCHEMA = "project_id long, path string, content string"


def test_scan_incremental_only_new_files(spark, tmpdir_path):
    src, sink, ckpt = (os.path.join(tmpdir_path, d) for d in ("src", "sink", "ckpt"))
    terms = spark.createDataFrame([(1, "foo"), (2, "bar")], "id long, name string")
    first = spark.createDataFrame([(1, "a.c", "foo bar\nfoo")], SCHEMA)
    first.write.parquet(os.path.join(src, "batch=1"))
    incremental.scan_incremental(spark, src, SCHEMA, lambda d: d.select("project_id", "path", "content"),
                                 terms, sink, ckpt)
    assert spark.read.parquet(sink).count() == 3
    second = spark.createDataFrame([(2, "b.c", "bar")], SCHEMA)
    second.write.parquet(os.path.join(src, "batch=2"))
    incremental.scan_incremental(spark, src, SCHEMA, lambda d: d.select("project_id", "path", "content"),
                                 terms, sink, ckpt)
    got = sorted((r.project_id, r.path, r.line_nr, r.term_id) for r in spark.read.parquet(sink).collect())
    batch = scan.scan_terms(explode_lines(first.unionByName(second)), terms, None)
    exp = sorted((r.project_id, r.path, r.line_nr, r.term_id) for r in batch.collect())
    assert got == exp  # each file scanned exactly once


def test_history_incremental_idempotent(spark, tmpdir_path):
    src, sink, ckpt = (os.path.join(tmpdir_path, d) for d in ("src", "sink", "ckpt"))
    rows = spark.createDataFrame([(1, "h1", 2), (1, "h1", -1), (2, "h2", 3)], "project_id long, hash string, delta int")
    rows.write.parquet(src)
    incremental.history_incremental(spark, src, "project_id long, hash string, delta int", lambda d: d, sink, ckpt)
    got = sorted((r.project_id, r.hash, r.net) for r in spark.read.parquet(sink).collect())
    assert got == [(1, "h1", 1), (2, "h2", 3)]
    # later batches bring the same project, and even the same commit
    more = spark.createDataFrame([(1, "h1", 5), (1, "h3", 4)], "project_id long, hash string, delta int")
    more.write.mode("append").parquet(src)
    for _ in range(2):
        incremental.history_incremental(spark, src, "project_id long, hash string, delta int", lambda d: d, sink, ckpt)
    got = sorted((r.project_id, r.hash, r.net) for r in incremental.read_history(spark, sink).collect())
    assert got == [(1, "h1", 6), (1, "h3", 4), (2, "h2", 3)]


def test_scan_incremental_keeps_unknown_names(spark, tmpdir_path):
    src, sink, ckpt = (os.path.join(tmpdir_path, d) for d in ("src", "sink", "ckpt"))
    spark.createDataFrame([(1, "a.c", "foo xbar")], SCHEMA).write.parquet(src)
    known = spark.createDataFrame([(1, "foo")], "id long, name string")
    incremental.scan_incremental(spark, src, SCHEMA, lambda d: d, known, sink, ckpt, unknown_pattern="^x[a-z]")
    full = spark.createDataFrame([(1, "foo"), (2, "xbar")], "id long, name string")
    got = sorted((r.term, r.term_id) for r in incremental.read_usages(spark, sink, full).collect())
    assert got == [("foo", 1), ("xbar", 2)]


def test_scan_with_growing_dictionary(spark, tmpdir_path):
    src, sink, log, ckpt = (os.path.join(tmpdir_path, d) for d in ("src", "sink", "log", "ckpt"))
    terms = spark.createDataFrame([(1, "foo"), (2, "bar")], "id long, name string")
    files = [(1, "a.c", "foo xb // xa\nfoo"), (1, "vendor/b.c", "xa xb xc"), (2, "c.c", 'xc "xd" bar\nfoo xb')]
    batches = [spark.createDataFrame([f], SCHEMA) for f in files]
    run = lambda: incremental.scan_growing(spark, src, SCHEMA, lambda d: d, terms, sink, log, ckpt,
                                           "^x[a-z]", max_files_per_trigger=1)
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(src)
        run()
    run()  # nothing new

    def state():
        words = incremental.read_dictionary(spark, terms, log)
        return words, sorted((r.name, r.id) for r in words.collect())

    words, ids = state()
    assert ids == [("bar", 2), ("foo", 1), ("xa", 3), ("xb", 4), ("xc", 5), ("xd", 6)]
    columns = ["project_id", "path", "line_nr", "line", "line_hash", "vendored", "marker", "term", "term_id"]
    rows = lambda df: sorted(df.select(*columns).withColumn(
        "why", exclude.fragment_category(F.col("line"), F.col("term"))).collect(), key=str)
    whole = scan.scan_terms(exclude.line_flags(explode_lines(spark.createDataFrame(files, SCHEMA))), words, None)
    expected = rows(whole)
    assert rows(incremental.read_usages(spark, sink, words)) == expected
    assert len({r.why for r in expected}) == 3  # code, comment, quotes
    # a batch run again changes nothing, later ids included
    incremental.scan_batch(batches[1], 1, terms, sink, log, "^x[a-z]", {})
    words, again = state()
    assert again == ids and rows(incremental.read_usages(spark, sink, words)) == expected


def test_series_in_order_and_split(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "series")
    df = spark.range(4000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 7)).alias("project_key"),
        F.pmod(F.hash("id"), F.lit(500)).alias("date"), F.col("id").alias("tie")).repartition(5)
    write_series_per_project(df, path, order=("date", "tie"), partitions=6)
    expected = {}
    for r in df.orderBy("date", "tie").collect():
        expected.setdefault(r.project_key, []).append(f"{r.date};{r.tie}")
    for key, series in expected.items():
        folder = os.path.join(path, f"project_key={key}")
        parts = [open(os.path.join(folder, f)).read().split() for f in sorted(os.listdir(folder)) if f.endswith(".csv")]
        assert [x for p in parts for x in p[1:]] == series
        assert key != "hot" or len(parts) > 2


def test_sample_items_of_any_id(spark):
    ids = [0, 1, 7, 3_400_000_000, 2 ** 40 + 3, 2 ** 63 - 1, -5]
    ids += list(range(100, 200))
    got = {r.project_id for r in ratings.sample_items(spark.createDataFrame([(i,) for i in ids], "project_id long")).collect()}
    assert got == {i for i in ids if (i * 2654435761 % 2 ** 32) * 100 < 15 * 2 ** 32}


def test_literal_prefix():
    assert scan.literal_prefix("^__builtin_[a-z]") == "__builtin_"
    assert scan.literal_prefix("^foo|^bar") is None
    assert scan.literal_prefix("^ab*c") == "a"
    assert scan.literal_prefix("foo") is None


def test_sinks(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "o", "p", 10.0, 3), (1, "o", "p", 20.0, 5), (2, "o", "q", 5.0, 1)],
                               "project_id long, owner string, name string, date double, nr_builtins int")
    keyed = df.withColumn("project_key", project_key())
    write_series_per_project(keyed.select("project_key", "date", "nr_builtins"), os.path.join(tmpdir_path, "series"))
    dirs = sorted(d for d in os.listdir(os.path.join(tmpdir_path, "series")) if d.startswith("project_key="))
    assert dirs == ["project_key=1-o-p", "project_key=2-o-q"]
    write_delimited(df.select("name", "nr_builtins"), os.path.join(tmpdir_path, "csv"))
    back = spark.read.option("header", "true").option("sep", ";").csv(os.path.join(tmpdir_path, "csv"))
    assert back.count() == 3 and back.columns == ["name", "nr_builtins"]


def test_scan_query_reads_a_file_per_slot_and_batch(spark, monkeypatch):
    from conftest import SF001
    from usagelens.plans.registry import QUERIES
    seen, plain = [], incremental.scan_incremental

    def watched(spark, src, *args, max_files_per_trigger, **more):
        seen.append((max_files_per_trigger, len(spark.read.parquet(src).inputFiles())))
        plain(spark, src, *args, max_files_per_trigger=max_files_per_trigger, **more)

    monkeypatch.setattr(incremental, "scan_incremental", watched)
    assert QUERIES["scan_incremental"](spark, SF001).count() > 0
    slots = spark.sparkContext.defaultParallelism
    assert len(seen) == 2 and all(n == slots and slots < files <= 4 * slots for n, files in seen)
