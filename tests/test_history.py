import random

import pytest

from pyspark.sql import functions as F

from usagelens.operators import history as H
from usagelens.operators import windows


def test_diff_deltas_micro(spark):
    terms = spark.createDataFrame([(1, "__builtin_clz")], "id long, name string")
    head = "--- a/a.c\n+++ b/__builtin_clz.c\n@@ -1 +1 @@\n"
    diffs = spark.createDataFrame([
        (1, "c1", "ADD", "a.c", "a.c", head + "+x = __builtin_clz(1);\n+y = 2;"),
        (1, "c2", "MODIFY", "a.c", "a.c", head + "-__builtin_clz(1)\n+__builtin_clz(2)\n __builtin_clz(3)"),
        (1, "c3", "DELETE", "a.c", "a.c", head + "-__builtin_clz(1)"),
        (1, "c4", "ADD", "a.cpp", "a.cpp", head + "+__builtin_clz(1)"),
        (1, "c5", "MODIFY", "a.c", "a.C", head + "--- __builtin_clz;\n+++ __builtin_clz;\n@@ -9 +9 @@\n+__builtin_clz"),
        (1, "c6", "MODIFY", "a.c", "a.cpp", head + "+__builtin_clz"),
    ], "project_id long, hash string, change_type string, old_path string, new_path string, diff string")
    got = sorted((r.hash, r.event, r.delta) for r in H.diff_deltas(diffs, terms).collect())
    assert got == [("c1", "add-file", 1), ("c2", "modify-add", 1), ("c2", "modify-delete", -1),
                   ("c3", "delete-file", -1), ("c5", "modify-add", 1), ("c5", "modify-add", 1),
                   ("c5", "modify-delete", -1)]


def test_first_parent_cycle_is_an_error(spark):
    commits = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "project_id long, hash string, parent string")
    with pytest.raises(ValueError):
        H.first_parent_chain(commits, commits.select("project_id", "hash").limit(1))


def test_snapshot_equals_diff_sum(spark):
    old = spark.createDataFrame([(1, 7, 1), (1, 7, 1), (1, 7, 2)], "project_id long, file_key long, term_id long")
    new = spark.createDataFrame([(1, 7, 1), (1, 7, 3)], "project_id long, file_key long, term_id long")
    got = sorted(tuple(r) for r in H.snapshot_deltas(old, new, ["project_id", "file_key"]).collect())
    assert got == [(1, 7, 1, -1), (1, 7, 2, -1), (1, 7, 3, 1)]


def test_running_sum_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(1, 3), f"h{i:04d}", rnd.randint(0, 10 * 86400), rnd.randint(-3, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, h string, ts long, v long")
    got = {r.h: r.acc for r in windows.running_sum(df, "k", "ts", "h", "v", "acc").collect()}
    exp = {}
    for k in {r[0] for r in rows}:
        acc = 0
        for r in sorted([r for r in rows if r[0] == k], key=lambda r: (r[2], r[1])):
            acc += r[3]
            exp[r[1]] = acc
    assert got == exp
    got = {r.h: r.n for r in windows.row_number(df, "k", "ts", "h", "n", descending=True).collect()}
    for k in {r[0] for r in rows}:
        for i, r in enumerate(sorted([r for r in rows if r[0] == k], key=lambda r: (-r[2], r[1]), reverse=False)):
            pass
    for k in {r[0] for r in rows}:
        ordered = sorted([r for r in rows if r[0] == k], key=lambda r: (r[2], r[1]), reverse=True)
        for i, r in enumerate(ordered):
            assert got[r[1]] == i + 1


def test_first_parent_chain_brute_force(spark):
    rnd = random.Random(3)
    parent = {0: None}
    for i in range(1, 300):
        parent[i] = rnd.randrange(0, i)
    df = spark.createDataFrame([(1, i, p) for i, p in parent.items()], "project_id long, hash long, parent long")
    heads = spark.createDataFrame([(1, 299)], "project_id long, hash long")
    got = {r.hash: r.commit_nr for r in H.first_parent_chain(df, heads).collect()}
    exp, node, n = {}, 299, 1
    while node is not None:
        exp[node] = n
        node, n = parent[node], n + 1
    assert got == exp


def test_trend_rules(spark):
    # project 1: 0 -> 3 -> 1 -> 4 -> 5 (one decrease), 5 points
    commits = spark.createDataFrame([(1, f"c{i}", i * 100, "a", "e", "m") for i in range(6)],
                                    "project_id long, hash string, ts_unix long, author string, email string, message string")
    deltas = spark.createDataFrame([(1, "c1", 3), (1, "c2", -2), (1, "c3", 3), (1, "c4", 1), (1, "c5", 0)],
                                   "project_id long, hash string, delta int")
    projects = spark.createDataFrame([(1, True)], "id long, history_checked boolean")
    net = H.commit_net(commits, deltas)
    nr = {r.hash: r.commit_nr for r in net.collect()}
    assert nr["c5"] == 1 and nr["c0"] == 6
    r = H.trend_rules(H.trend_features(net, projects)).first()
    # n = 4 non-zero commits; values 3, 1, 4, 5; median position 3 -> 4
    assert (r.few_commits, r.monotonic, r.mostly_increasing) == (True, False, False)


def test_running_sum_hot_key_same_timestamp(spark):
    # one key with most rows, all at the same second: order falls to the tie column
    rows = [(1, f"h{i:05d}", 100, 1) for i in range(3000)] + [(2, f"g{i:03d}", i, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, h string, ts long, v long")
    got = {r.h: r.acc for r in windows.running_sum(df, "k", "ts", "h", "v", "acc", partitions=8).collect()}
    assert got["h00000"] == 1 and got["h02999"] == 3000 and got["g049"] == 100
    assert all(got[f"h{i:05d}"] == i + 1 for i in range(3000))


def test_snapshot_deltas_null_keys_stay_apart_without_join(spark):
    schema = "project_id long, file_key long, term_id long"
    old = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (None, 1, 1)], schema)
    new = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (None, 1, 1)], schema)
    out = H.snapshot_deltas(old, new, ["project_id", "file_key"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, 1, 2, -1), (1, 2, 2, 1), (None, 1, 1, -1), (None, 1, 1, 1)], key=str)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
