from pyspark.sql import functions as F

from usagelens.operators import exclude

# FIXTURES.md section 4: T7 / T8 micro-rows for the term __builtin_clz
ROWS = [
    ("x = __builtin_clz(y);", None),
    ("// see __builtin_clz", "COMMENT"),
    ("x = __builtin_clz(y); // fast", None),
    ("/* uses __builtin_clz */", "COMMENT"),
    ("/* a * b */ __builtin_clz(y)", None),
    ("  * calls __builtin_clz", "COMMENT"),
    ('puts("__builtin_clz");', "QUOTES"),
    ('puts("a"); __builtin_clz(y); puts("b");', "QUOTES"),
]


def test_fragment_rules(spark):
    df = spark.createDataFrame([(l,) for l, _ in ROWS], "line string")
    got = [r[0] for r in df.select(exclude.fragment_category(F.col("line"), F.lit("__builtin_clz"))).collect()]
    assert got == [e for _, e in ROWS]


def test_fragment_rules_match_plain_string_rules(spark):
    # the column expression equals the rules in plain string operations
    lines = ["a /* x */ b /* c n", "n // a", "/* * n", '"n"', 'n "x"', '"x" n', "/*/* n", "// n n",
             "\t* n", "*n", "x /* y n */ z", '" n', 'a "b n c" d', "/**/ n"]
    name = "n"

    def ref(line):
        places = [i for i in range(len(line)) if line.startswith(name, i)]
        opened = [j + 2 for j in range(len(line) - 1) if line[j:j + 2] == "/*"]
        if any("//" in line[:i] for i in places) or line.lstrip(" \t").startswith("* ") \
                or any(j <= i and "*" not in line[j:i] for i in places for j in opened):
            return "COMMENT"
        if any('"' in line[:i] and '"' in line[i + len(name):] for i in places):
            return "QUOTES"
        return None

    df = spark.createDataFrame([(l,) for l in lines], "line string")
    got = [r[0] for r in df.select(exclude.fragment_category(F.col("line"), F.lit(name))).collect()]
    assert got == [ref(l) for l in lines]


def test_vendored_dirs(spark):
    paths = [("p/src/gcc-4.8/a.c", True), ("p/GCC/a.c", True), ("p/src/gcc.c", False),
             ("gcc-fork/a.c", False), ("p/llvm/x/a.c", True)]
    df = spark.createDataFrame([(p,) for p, _ in paths], "path string")
    got = [r[0] for r in df.select(exclude.in_vendored_dir("path")).collect()]
    assert got == [v for _, v in paths]


def test_project_filter(spark):
    rows = [(1, "a", 90, 20, True), (2, "gcc", 500, 0, True), (3, "b", 50, 0, True), (4, "c", 500, 0, False)]
    df = spark.createDataFrame(rows, "id long, name string, loc_c long, loc_h long, processed boolean")
    assert [r["id"] for r in exclude.project_filter(df).collect()] == [1]


def _usages(spark):
    rows = [(1, "p/a.c", "// n", 1), (1, "p/a.c", "n m", 2), (2, "p/gcc/b.c", "// n", 1), (2, "p/b.c", "m n", 2),
            (2, "p/c.c", "n m", 1), (3, "p/c.c", "// n", 2), (3, "p/c.c", "m", None)]
    u = spark.createDataFrame(rows, "project_id long, path string, line string, term_id long")
    return exclude.line_flags(u).withColumn("excluded", F.col("path") == "p/a.c") \
        .withColumn("line_key", exclude.line_key(F.col("line"))) \
        .withColumn("auto_category", F.when((F.col("line") == "// n") & (F.col("term_id") == 1) & ~F.col("vendored"), "COMMENT")) \
        .drop("line", "line_hash")


def test_usages_are_marked_alike_whatever_is_broadcast(spark, monkeypatch):
    # (line, term) pairs listed: ("// n", 1) and, by hand, ("n m", 2)
    want = {True: [True, True, True, False, False, False, False], False: [True, True, True, False, True, True, False]}
    usages = _usages(spark)
    for fragments_, lines in [(16 << 20, 10), (0, 10), (0, 0)]:
        monkeypatch.setattr(exclude, "FRAGMENT_BROADCAST_BYTES", fragments_)
        monkeypatch.setattr(exclude, "MAX_BROADCAST_LINES", lines)
        fragments = exclude.sync_manual(usages, exclude.fragments_from_scan(usages))
        for by_term, flags in want.items():
            got = exclude.mark_excluded(usages, fragments, by_term).collect()
            assert sorted(r["excluded"] for r in got) == sorted(flags)
            assert sum(r["excluded"] and r["project_id"] == 3 for r in got) == flags[5]


def test_usages_hold_no_line_text(spark):
    from conftest import SF001
    from usagelens.plans.queries import study
    s = study(spark, SF001)
    assert "line" not in s.usages_raw.columns and "line" not in s.fragments.columns
    texts = s.with_lines(s.fragments)
    assert texts.columns == ["line", "term_id", "category"] and texts.count() == s.fragments.count()
