"""Top-k search against brute force: ties, negative and huge scores, null and
non-finite components, repeated ids, vectors of several lengths."""
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from usagelens.llm import topk_search


def brute_top(rows, every, k):
    whole = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(whole):
        if i is None or i % every:
            continue
        low, high = -(1 << 63), (1 << 63) - 1
        found = [(-min(max(sum(x * y for x, y in zip(q, v)), low), high), j is None, j or 0) for b, (j, v) in enumerate(whole) if a != b]
        for rank, (s, none, j) in enumerate(sorted(found)[:k], 1):
            out.append((i, rank, None if none else j, -s))
    return sorted(out, key=str)


def vectors(seed, n, spread):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        size = 12 if i % 7 else rnd.randrange(0, 20)
        rows.append((i, [rnd.choice([0.0, rnd.gauss(0, spread), rnd.gauss(0.2, spread)]) for _ in range(size)]))
    rows += [(n + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(10, rows[5][1]), (10, rows[5][1]), (None, rows[3][1]), (20, None), (30, [1.0, None]),
             (40, [float("nan")] * 12), (50, [float("inf")] + [0.0] * 11), (60, []), (-10, rows[8][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, spread, cells", [(1, 0.3, 1 << 20), (2, 0.3, 300), (3, 1e30, 300), (4, 2e5, 900)])
def test_top_k_equals_brute_force(spark, monkeypatch, seed, spread, cells):
    monkeypatch.setattr(topk_search, "SHARD_CELLS", cells)
    monkeypatch.setattr(topk_search, "BLOCK_CELLS", 200)
    rows = vectors(seed, 150, spread)
    df = spark.createDataFrame([(i, v, 5, 7) for i, v in rows],
                               "vec_id long, embedding array<double>, score int, row int").repartition(3)
    got = [tuple(r) for r in topk_search.top_k(df, every=10, k=4).collect()]
    assert sorted(got, key=str) == brute_top(rows, 10, 4)


def test_non_essential_terms_are_not_traversed():
    """A row found by no essential term stays out, one that ties stays in."""
    index = topk_search._shard(0, pa.array([1, 2, 3]), [
        np.array(v) for v in ([1.0, 0.0], [0.0, 1.0], [0.5, 0.0])])
    shard = topk_search.Shard(*[index.column(i)[0].as_py() for i in range(6)])
    rows, scores = shard.search({0: 10, 1: 1}, 1280, None)
    assert (rows.tolist(), scores.tolist()) == ([0, 2], [2560, 1280])
