from pyspark.sql import functions as F

from usagelens.functions import text as T


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_identifiers_whole_tokens(spark):
    # F1 micro-rows: a name only matches as a whole identifier
    assert one(spark, T.identifiers("x"), "my__builtin_clz __builtin_clzx(__builtin_)") == \
        ["my__builtin_clz", "__builtin_clzx", "__builtin_"]
    assert one(spark, T.identifiers("x"), "a(b) a") == ["a", "b", "a"]


def test_split_lines(spark):
    assert one(spark, T.split_lines("x"), "a\r\nb\rc\nd\n") == ["a", "b", "c", "d"]
    assert one(spark, T.split_lines("x"), "a\n\nb") == ["a", "", "b"]


def test_path_and_message_helpers(spark):
    assert one(spark, T.base_name("x"), "p/src/a.c") == "a.c"
    assert one(spark, T.first_line("x"), "fix bug\n\nlong text") == "fix bug"
    assert one(spark, T.remove_suffix("x", ".def"), "offsetof.def") == "offsetof"
    assert one(spark, T.remove_suffix("x", "-libc"), "other-libc") == "other"
    assert one(spark, T.metric_suffix("x"), "arm-c-extensions2") == "armcextensions"
    assert one(spark, T.label_suffix("x"), "less than 5 commits") == "lessthanfivecommits"
    assert one(spark, T.short_header("x"), "6.60.1 AArch64 Built-in Functions") == "6.60.1 AArch64 "


def test_url_parts(spark):
    assert one(spark, T.url_owner("x"), "https://github.com/acme/widget") == "acme"
    assert one(spark, T.url_name("x"), "https://github.com/acme/widget") == "widget"
    assert one(spark, T.url_name("x"), "https://example.org/a") is None


def test_natural_join_and_prefix(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "x array<string>")
    got = [r[0] for r in df.select(T.natural_join("x")).collect()]
    assert got == ["a, b, and c", "a"]
    # F15 documented example
    assert one(spark, T.prefix_list("x"), "_exit, alloca") == ["__builtin__exit", "__builtin_alloca"]


def test_integer_division_and_sign(spark):
    assert one(spark, T.idiv("x", 1000), 123456, "x long") == 123
    df = spark.createDataFrame([(1,), (-1,), (0,)], "x int")
    assert [r[0] for r in df.select(T.sign_symbol("x")).collect()] == ["+", "-", None]


def test_null_safe_is_not(spark):
    # X IS NOT 1 over (NULL, 0, 1) -> (true, true, false)
    df = spark.createDataFrame([(None,), (0,), (1,)], "x int")
    got = [r[0] for r in df.select(~F.col("x").eqNullSafe(1)).collect()]
    assert got == [True, True, False]
