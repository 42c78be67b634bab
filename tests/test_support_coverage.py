import math
import random
import statistics

import pytest

from usagelens.operators import coverage as C
from usagelens.operators import support as S


def _needs(spark, rows):
    return spark.createDataFrame(
        [(p, t, f"t{t}", "libc" if t % 5 == 0 else "other", t % 2 == 0) for p, t in rows],
        "project_id long, term_id long, name string, category string, machine_specific boolean")


def _greedy_brute(rows, steps):
    projects = {}
    for p, t in rows:
        projects.setdefault(p, set()).add(t)
    freq = {}
    for p, ts in projects.items():
        for t in ts:
            freq[t] = freq.get(t, 0) + 1
    order = sorted(freq, key=lambda t: (-freq[t], t))
    chosen, out = set(), []
    for _ in range(steps):
        rest = [t for t in order if t not in chosen]
        best = min(rest, key=lambda t: (sum(1 for ts in projects.values() if not ts <= chosen | {t}),
                                        order.index(t)))
        chosen.add(best)
        out.append(sum(1 for ts in projects.values() if ts <= chosen))
    return out


def test_greedy_and_frequency_curves(spark):
    rnd = random.Random(11)
    rows = list({(p, rnd.choice([1, 1, 1, 2, 2, 3, 4, 5, 6, 7])) for p in range(60) for _ in range(rnd.randint(1, 3))})
    needs = _needs(spark, rows)
    g = [r.supported for r in S.support_greedy(needs).orderBy("nr_terms").collect()]
    assert g == _greedy_brute(rows, 7)
    f = [r.pct_projects for r in S.support_by_frequency(needs).orderBy("nr_terms").collect()]
    assert f[-1] == 100.0 and g[-1] == 60
    assert g[0] >= [r.supported for r in S.support_by_frequency(needs).orderBy("nr_terms").collect()][0]


@pytest.mark.parametrize("known", [1, 30, 10 ** 6])
def test_greedy_order_in_rounds(spark, known):
    rnd = random.Random(known)
    rows = sorted({(p, int(rnd.paretovariate(0.7)) % 15) for p in range(80) for _ in range(rnd.randint(1, 5))})
    needs = _needs(spark, rows)
    cand, _ = S.start_configuration(needs, False, False)
    order = {r.step: r.term_id for r in S.greedy_order(needs, cand, known_terms=known).collect()}
    projects, chosen, out = {}, set(), []
    for p, t in rows:
        projects.setdefault(p, set()).add(t)
    for step in sorted(order):
        chosen.add(order[step])
        out.append(sum(ts <= chosen for ts in projects.values()))
    assert out == _greedy_brute(rows, len(order)) and len(set(order.values())) == len({t for _, t in rows})


def test_greedy_picks_many_terms_in_few_jobs(spark):
    rows = [(p, t) for p in range(40) for t in (p, 40 + p, 80 + (p * 7) % 300, 400 + p)] + [(99, t) for t in range(3000)]
    needs = _needs(spark, rows)
    jobs, cut = [], S.cut_lineage
    S.cut_lineage = lambda df: jobs.append(1) or cut(df)
    try:
        assert S.support_greedy(needs).count() == 3000
    finally:
        S.cut_lineage = cut
    assert len(jobs) < 50


def _sim(dims, sd):
    def near(a, b, i, kind):
        if a[i] is None or b[i] is None:
            return False
        if kind == "equal":
            return a[i] == b[i]
        if kind == "band":
            return abs(math.log10(a[i] + 1) - math.log10(b[i] + 1)) <= 0.5
        return abs(a[i] - b[i]) <= sd[i]
    return lambda a, b: all(near(a, b, i, k) for i, k in enumerate(dims.values(), 1))


@pytest.mark.parametrize("dims", [
    {"age": "sd"}, {"size": "sd", "age": "band"}, {"size": "band", "age": "sd", "other": "band", "kind": "equal"}])
def test_coverage_equals_all_pairs(spark, dims):
    rnd = random.Random(len(dims))
    pick = lambda v: None if rnd.random() < 0.05 else v
    uni = [(i, *[pick(rnd.choice("ab") if d == "kind" else float(int(rnd.paretovariate(0.4)) % 6000)) for d in dims])
           for i in range(250)]
    schema = "repository long, " + ", ".join(f"{d} {'string' if d == 'kind' else 'double'}" for d in dims)
    u = spark.createDataFrame(uni, schema).repartition(3)
    s = u.where("repository % 17 = 0")
    sample = [r for r in uni if r[0] % 17 == 0]
    sd = {i: statistics.stdev([r[i] for r in uni if r[i] is not None]) for i, k in enumerate(dims.values(), 1) if k == "sd"}
    sim = _sim(dims, sd)
    open_ = {a[0] for a in uni if not any(sim(a, b) for b in sample)}
    got = C.coverage_score(u, s, dims).first()
    assert got.covered == 250 - len(open_)
    plan = C.covered(u, s, dims)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for r in C.coverage_by_dimension(u, s, dims).collect():
        i = list(dims).index(r.dimension) + 1
        alone = _sim({r.dimension: dims[r.dimension]}, {1: sd.get(i)})
        hit = sum(any(alone((0, a[i]), (0, b[i])) for b in sample) for a in uni)
        assert r.score == round(hit / 250, 6)
    expected = []
    for step in range(1, 3):
        gain = {a[0]: {b[0] for b in uni if b[0] in open_ and sim(a, b)} for a in uni}
        best = min(gain, key=lambda k: (-len(gain[k]), k))
        if not gain[best]:
            break
        open_ -= gain[best]
        expected.append((step, best, len(gain[best]), round((250 - len(open_)) / 250, 6)))
    assert [tuple(r) for r in C.coverage_next(u, s, dims, 2, leaders=9).collect()] == expected


def test_coverage_matches_theta_join(spark):
    rnd = random.Random(5)
    uni = [(i, float(rnd.randint(1, 5000)), float(rnd.randint(1, 50)), rnd.choice("ab")) for i in range(300)]
    u = spark.createDataFrame(uni, "repository long, size double, age double, kind string")
    s = u.where("repository % 7 = 0")
    dims = {"size": "band", "age": "band", "kind": "equal"}

    def sim(a, b):
        return all(abs(math.log10(a[k] + 1) - math.log10(b[k] + 1)) <= 0.5 for k in (1, 2)) and a[3] == b[3]

    sample = [r for r in uni if r[0] % 7 == 0]
    exp = sum(1 for a in uni if any(sim(a, b) for b in sample))
    got = C.coverage_score(u, s, dims).first()
    assert got.covered == exp and got.universe == 300
    nxt = C.coverage_next(u, s, dims, 2).collect()
    assert len(nxt) == 2 and nxt[0].score <= nxt[1].score <= 1.0
