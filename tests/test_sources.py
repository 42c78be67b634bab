import os

import pytest
from pyspark.sql import functions as F

from usagelens.operators import scan
from usagelens.operators.tables import extend_dictionary
from usagelens.schema import TERMS
from usagelens.sources import files as S


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_source_tree_scan(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "projects")
    _write(f"{root}/o-p/src/a.c", b"int x = __builtin_clz(y);\r\n// __builtin_clz\r\nz")
    _write(f"{root}/o-p/src/B.C", b"__builtin_expect(a, 1) + __builtin_expect(b, 0)\n")
    _write(f"{root}/o-p/src/c.cpp", b"__builtin_clz(1);\n")
    _write(f"{root}/o-p/Makefile", b"CFLAGS = -ffreestanding\n")
    _write(f"{root}/q-r/x.h", b"my__builtin_clz(1); __builtin_clzx(2);\n\xff\xfe bad bytes __builtin_clz\n")
    files = S.read_source_tree(spark, root)
    got = {(r.project, r.path, r.is_makefile) for r in files.collect()}
    assert got == {("o-p", "o-p/src/a.c", False), ("o-p", "o-p/src/B.C", False),
                   ("o-p", "o-p/Makefile", True), ("q-r", "q-r/x.h", False)}
    lines = S.explode_lines(files.where(~F.col("is_makefile")).select("project", "path", "content"))
    a = sorted((r.line_nr, r.line) for r in lines.where(F.col("path") == "o-p/src/a.c").collect())
    assert a == [(1, "int x = __builtin_clz(y);"), (2, "// __builtin_clz"), (3, "z")]
    terms = spark.createDataFrame([(1, "__builtin_clz"), (2, "__builtin_expect")], "id long, name string")
    u = scan.scan_terms(lines, terms, scan.UNKNOWN_PATTERN)
    got = sorted((r.path, r.line_nr, r.term, r.term_id) for r in u.collect())
    assert got == [("o-p/src/B.C", 1, "__builtin_expect", 2), ("o-p/src/B.C", 1, "__builtin_expect", 2),
                   ("o-p/src/a.c", 1, "__builtin_clz", 1), ("o-p/src/a.c", 2, "__builtin_clz", 1),
                   ("q-r/x.h", 1, "__builtin_clzx", None), ("q-r/x.h", 2, "__builtin_clz", 1)]
    mk = S.explode_lines(files.where(F.col("is_makefile")).select(F.col("project").alias("project_id"), "content"))
    flags = scan.config_flags(mk).first()
    assert (flags.has_makefile, flags.freestanding, flags.no_builtin) == (True, True, False)


def test_definitions(spark):
    files = spark.createDataFrame([
        ("/d/offsetof.def", "# comment\n%url=u1\n%header=h1\n__builtin_offsetof\n"),
        ("/d/architecture-specific/arm.def", "%url=u2\n%header=h2\n__builtin_arm_a\n%header=h3\n__builtin_arm_b\n"),
    ], "file string, content string")
    terms, bad = S.parse_definitions(files)
    assert bad.count() == 0
    got = sorted((r.name, r.category, r.machine_specific, r.doc_url, r.header) for r in terms.collect())
    assert got == [("__builtin_arm_a", "arm", True, "u2", "h2"), ("__builtin_arm_b", "arm", True, "u2", "h3"),
                   ("__builtin_offsetof", "offsetof", False, "u1", "h1")]
    broken = spark.createDataFrame([
        ("/d/a.def", "%url=u\n__builtin_x\n%bogus=1\n"),
        ("/d/b.def", "%url=u\n%header=h\n__builtin_y\n"),
        ("/d/c.def", "%url=u\n%header=h\n__builtin_y\n"),
    ], "file string, content string")
    _, bad = S.parse_definitions(broken)
    problems = sorted(r.problem for r in bad.collect())
    assert problems == ["%bogus=1 is unknown", "duplicate __builtin_y", "duplicate __builtin_y",
                        "header not defined"]


def test_read_definition_files(spark, tmpdir_path):
    _write(f"{tmpdir_path}/defs/overflow.def", b"%url=u\n%header=h\n__builtin_add_overflow\n")
    _write(f"{tmpdir_path}/defs/bad.def", b"__builtin_nourl\n")
    with pytest.raises(S.DefinitionError):
        S.read_term_definitions(spark, f"{tmpdir_path}/defs")
    _write(f"{tmpdir_path}/ex/type.def", b"# is a type\n__builtin_va_list\n")
    ex = S.read_exclusions(spark, f"{tmpdir_path}/ex").collect()
    assert [(r.name, r.reason) for r in ex] == [("__builtin_va_list", "type")]


def test_key_value_and_delimited(spark, tmpdir_path):
    lines = spark.createDataFrame([("__builtin_expect=compiler interaction",), ("",)], "line string")
    assert [tuple(r) for r in S.parse_key_value(lines).collect()] == [("__builtin_expect", "compiler interaction")]
    for i in range(2):
        _write(f"{tmpdir_path}/csv/{i}-o-p.csv", f"date;nr_builtins\n1.0;{i}\n2.0;{i + 1}\n".encode())
    df = S.read_delimited_glob(spark, f"{tmpdir_path}/csv/*.csv", ";", "date double, nr_builtins int")
    got = sorted((r.source, r.nr_builtins) for r in df.collect())
    assert got == [("0-o-p", 0), ("0-o-p", 1), ("1-o-p", 1), ("1-o-p", 2)]


def test_project_metadata_and_vcs(spark, tmpdir_path):
    _write(f"{tmpdir_path}/pages/p1.json",
           b'{"items": [{"owner": {"login": "a"}, "name": "x", "html_url": "https://github.com/a/x",'
           b' "stargazers_count": 400, "forks_count": 1, "open_issues_count": 2, "watchers_count": 3,'
           b' "fork": false, "created_at": "2015-01-02T03:04:05Z", "language": "C", "description": "d"}]}')
    m = S.read_project_metadata(spark, f"{tmpdir_path}/pages").first()
    assert (m.owner, m.name, m.stars, m.fork) == ("a", "x", 400, False)
    commits = spark.createDataFrame([
        (1, "h1", 10, "ann", []), (1, "h2", 20, "bob", ["h1"]), (1, "h3", 30, "ann", ["h2", "hx"])],
        "project_id long, hash string, ts_unix long, author string, parents array<string>")
    v = S.project_vcs_stats(commits).first()
    assert (v.commits, v.committers, v.first_ts, v.last_ts, v.head_hash) == (2, 2, 10, 30, "h3")
    rep = spark.createDataFrame([(1, "Language files blank comment code\nC 10 5 5 1200\n"
                                     "C/C++ Header 3 1 1 300\nAssembly 1 0 0 7\n")],
                                "project_id long, report string")
    r = S.loc_report(rep).first()
    assert (r.loc_c, r.loc_h, r.loc_cpp, r.loc_asm) == (1200, 300, 0, 7)


def test_extend_dictionary(spark):
    t = spark.createDataFrame([(1, "a", "c", False, None, None, True)], TERMS)
    names = spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "name string")
    out = extend_dictionary(t, names, {"category": "Unknown", "documented": False})
    got = sorted((r.id, r.name, r.category) for r in out.collect())
    assert got == [(1, "a", "c"), (2, "b", "Unknown"), (3, "c", "Unknown")]


def test_discover_terms_prefix_filter(spark):
    assert scan.literal_prefix("^__builtin_[a-zA-Z0-9]") == "__builtin_"
    assert scan.literal_prefix("<[a-z]") is None
    lines = spark.createDataFrame([("x = __builtin_new1(a) + __builtin_clz(b);",), ("nothing here",),
                                   ("my__builtin_no __builtin_new2",)], "line string")
    known = spark.createDataFrame([("__builtin_clz",)], "name string")
    got = sorted(r.name for r in scan.discover_terms(lines, known).collect())
    assert got == ["__builtin_new1", "__builtin_new2"]


def test_discover_terms_takes_identifiers_by_prefix(spark):
    lines = spark.createDataFrame([("__builtin_a1(x__builtin_b, __builtin_c9_d)",), ("__builtin_, é__builtin_z2",)], "line string")
    found = scan.discover_terms(lines, spark.createDataFrame([("__builtin_a1",)], "name string"))
    assert sorted(r.name for r in found.collect()) == ["__builtin_c9_d", "__builtin_z2"]
    assert "(?<![A-Za-z0-9_])__builtin_" in found._jdf.queryExecution().optimizedPlan().toString()


def test_balance_cuts_large_files_without_sorting(spark, tmp_path, monkeypatch):
    from usagelens.sources import files
    path = str(tmp_path / "t")
    spark.range(4000).selectExpr("id", "sha2(string(id), 256) AS text").repartition(8).write.parquet(path)
    df = spark.read.parquet(path)
    assert files.balance(df).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    monkeypatch.setattr(files, "LARGE_FILE_BYTES", 1 << 10)
    monkeypatch.setattr(files, "TASK_BYTES", 8 << 10)
    dealt = files.balance(df)
    assert dealt.rdd.getNumPartitions() > 16 and dealt.count() == 4000
    assert "RoundRobin" not in dealt._jdf.queryExecution().executedPlan().toString()


def test_projects_by_terms_sorts_no_usages(spark):
    from usagelens.operators import usage
    u = spark.createDataFrame([(1, "u1", 2500, 7), (1, "u1", 2500, 8), (2, "u2", 900, 7), (None, "u", 1, 1)],
                              "project_id long, url string, loc long, term_id long")
    out = usage.projects_by_terms(u, 2, unique=False)
    assert [tuple(r) for r in out.collect()] == [(1, "u1", 2, 2), (2, "u2", 0, 1)]
    assert "first(" not in out._jdf.queryExecution().executedPlan().toString()
