"""Order statistics against sorting in plain Python."""
import random
from statistics import median, quantiles

from pyspark.sql import functions as F

from usagelens.operators import order_stats as O


def test_upper_medians_of_several_columns(spark):
    rnd = random.Random(2)
    big = 1 << 60  # not exact as a double
    rows = [(rnd.randrange(-5, 5), big + rnd.randrange(100), rnd.choice([None, rnd.random()]), None) for _ in range(500)]
    df = spark.createDataFrame(rows, "a int, b long, c double, d long").repartition(5)
    got = O.upper_median_row(df, {c: F.col(c) for c in "abcd"}).first()
    for i, c in enumerate("abc"):
        values = sorted(r[i] for r in rows if r[i] is not None)
        assert got[c] == values[len(values) // 2]
    assert got["d"] is None
    one = spark.createDataFrame([(5,), (1,), (3,), (9,)], "x long")
    assert one.agg(F.count("*").alias("n")).select("n", O.upper_median(one, "x").alias("m")).first()["m"] == 5


def test_median_by_row_with_ties(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(4), (1 << 55) + i) for i in range(201)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "loc long, id long").repartition(4)
    assert O.median_by_row(df, "loc", "id").first()["id"] == sorted(rows)[len(rows) // 2][1]
    assert O.median_by_row(df.limit(0), "loc", "id").count() == 0


def test_interpolated_quantiles_by_group(spark):
    rnd = random.Random(4)
    rows = [(g, rnd.randrange(30)) for g, n in (("a", 101), ("b", 40), ("c", 2), ("d", 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(3)
    ranked = O.ranked_values(df, {"x": F.col("x")}, ["g"])
    got = {r["g"]: r for r in O.quantiles(ranked, ["g"], F.col("whole").cast("double"), {"q": 0.25, "m": 0.5}).collect()}
    for g in "abcd":
        values = [x for k, x in rows if k == g]
        assert got[g]["m"] == median(values)
        assert got[g]["q"] == (quantiles(values, n=4, method="inclusive")[0] if len(values) > 1 else values[0])
