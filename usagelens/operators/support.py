"""Support order C1-C4: which terms to implement first so that most
projects are fully supported.

Input ``needs``: distinct (project_id, term_id, name, category,
machine_specific) -- the terms each project uses (unknown terms removed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import broadcast_checked
from .windows import global_rank, global_running_sum

# Category of libc-like terms; decision names of the output
LIBC_CATEGORY = "other-libc"
MOST_FREQUENT, GREEDY = "most-frequent", "greedy"
# Shares of projects reported by the threshold table
THRESHOLDS = [10.0, 50.0, 90.0, 99.0, 99.99]
# missing terms of the sets that the driver looks at to pick several terms per job
KNOWN_TERMS = 200_000


def frequency(needs: DataFrame) -> DataFrame:
    """Terms by number of projects, ranked (1 = most frequent; ties by id)
    with a distributed sort (``windows.global_rank``)."""
    counts = needs.groupBy("term_id", "name", "category", "machine_specific") \
        .agg(F.count("*").alias("projects"))
    return global_rank(counts, [F.col("projects").desc(), F.col("term_id")], "freq_rank")


def start_configuration(needs: DataFrame, assume_libc: bool, assume_specific: bool,
                        libc_category: str = LIBC_CATEGORY) -> tuple[DataFrame, DataFrame]:
    """(candidates, already implemented) term sets.

    assume_specific: machine-specific terms count as implemented; assume_libc:
    libc-like terms count as implemented. (The study's both-true branch
    seeds the inverse set; here both sets are seeded.)"""
    terms = needs.groupBy("term_id", "name", "category", "machine_specific") \
        .agg(F.count("*").alias("projects"))
    spec = F.col("machine_specific").eqNullSafe(True)
    libc = F.col("category").eqNullSafe(libc_category)
    done = F.lit(False)
    if assume_specific:
        done = done | spec
    if assume_libc:
        done = done | libc
    # candidates ranked by frequency (1 = most frequent, ties by id)
    cand = global_rank(terms.where(~done), [F.col("projects").desc(), F.col("term_id")], "freq_rank")
    return cand, terms.where(done).select("term_id")


def support_by_frequency(needs: DataFrame, assume_libc: bool = False,
                         assume_specific: bool = False,
                         libc_category: str = LIBC_CATEGORY) -> DataFrame:
    """Implement the candidates by descending frequency; after step
    i, the number and % of projects all of whose terms are implemented.

    One pass: a project becomes supported at the largest step among its
    terms (0 for terms implemented from the start); a running count over the
    steps gives the curve.
    """
    cand, done = start_configuration(needs, assume_libc, assume_specific, libc_category)
    return support_curve(needs, cand.select("term_id", "name", F.col("freq_rank").alias("step")), done, MOST_FREQUENT)


def support_curve(needs: DataFrame, order: DataFrame, done: DataFrame, decision: str) -> DataFrame:
    """After each step of ``order`` (term_id, name, step) the number and % of
    projects all of whose terms are implemented (``done`` from the start; a term
    in neither is never implemented)."""
    ranks = broadcast_checked(order.select("term_id", "step").unionByName(done.withColumn("step", F.lit(0))))
    per_project = needs.select("project_id", "term_id").join(ranks, "term_id", "left") \
        .groupBy("project_id").agg(F.max("step").alias("need"), F.count_if(F.col("step").isNull()).alias("never")) \
        .where("never = 0")
    total = needs.select("project_id").distinct().agg(F.count("*")).scalar()
    at = per_project.groupBy("need").agg(F.count("*").alias("newly"))
    base = at.where("need = 0").agg(F.coalesce(F.sum("newly"), F.lit(0))).scalar()
    curve = global_running_sum(
        order.join(at, at.need == order.step, "left").select("step", "name", F.coalesce("newly", F.lit(0)).alias("newly")),
        [F.col("step")], "newly", "supported")
    return (curve
            .select(F.col("step").cast("int").alias("nr_terms"), "name",
                    (F.col("supported") + base).alias("supported"),
                    F.round(F.try_divide((F.col("supported") + base) * 100.0, total), 6)
                    .alias("pct_projects"),
                    F.lit(decision).alias("decision")))


def support_greedy(needs: DataFrame, steps: int | None = None, assume_libc: bool = False,
                   assume_specific: bool = False, libc_category: str = LIBC_CATEGORY) -> DataFrame:
    """Each step implements the candidate that leaves the fewest
    projects unsupported (= supports most projects whose only missing term it
    is); ties and zero gains go to the most frequent remaining candidate.

    The curve is that of the picked order. See ``greedy_order``.
    """
    cand, done = start_configuration(needs, assume_libc, assume_specific, libc_category)
    return support_curve(needs, greedy_order(needs, cand, steps), done, GREEDY)


def greedy_order(needs: DataFrame, cand: DataFrame, steps: int | None = None,
                 known_terms: int = KNOWN_TERMS) -> DataFrame:
    """(term_id, name, step): the candidates in greedy order.

    State: the distinct sets of missing terms (by frequency rank, ascending) with
    the number of projects that miss exactly that set; equal sets fall together
    as terms are picked. A round is one job and picks several terms:

    * While every set misses two terms or more, no pick gains anything, so
      terms go by frequency up to the smallest second-last rank of a set: then
      that set misses one term. One minimum gives the whole run.
    * Else the sets of at most D missing terms are enough for D picks: after j
      picks every other set still misses D + 1 - j terms. D is the largest
      for which these sets hold at most ``known_terms`` terms.
    * If even the sets of one missing term are more than that, their gains are
      added up in a table and the first is picked.
    """
    spark = needs.sparkSession
    n = cand.count()
    limit = n if steps is None else min(steps, n)
    ranked = needs.select("project_id", "term_id").join(cand.select("term_id", "freq_rank"), "term_id")
    state = cut_lineage(ranked.groupBy("project_id").agg(F.array_sort(F.collect_set("freq_rank")).alias("s"))
                        .groupBy("s").agg(F.count("*").alias("w")))
    picks: list[int] = []
    left = set(range(1, n + 1))
    while len(picks) < limit:
        sizes = dict(state.groupBy(F.size("s").alias("m")).agg(F.count("*").alias("c")).collect())
        if not sizes:
            batch = sorted(left)
        elif min(sizes) > 1:
            last = state.agg(F.min(F.expr("s[size(s) - 2]"))).first()[0]
            batch = sorted(r for r in left if r <= last)
        else:
            total, depth = 0, 0
            for m in range(1, max(sizes) + 1):
                total += m * sizes.get(m, 0)
                if total > known_terms:
                    break
                depth = m
            if depth:
                known = state.where(F.size("s") <= depth).collect()
                batch = _greedy_picks([(r["s"], r["w"]) for r in known], left,
                                      len(left) if depth == max(sizes) else depth)
            else:
                best = state.where("size(s) = 1").groupBy(F.col("s")[0].alias("rank")).agg(F.sum("w").alias("gain")) \
                    .orderBy(F.desc("gain"), "rank").first()
                batch = [best["rank"]]
        batch = batch[:limit - len(picks)]
        picks += batch
        left.difference_update(batch)
        if len(picks) < limit:
            state = cut_lineage(state.select(F.array_except("s", F.lit(batch).cast("array<bigint>")).alias("s"), "w")
                                .where("size(s) > 0").groupBy("s").agg(F.sum("w").alias("w")))
    order = spark.createDataFrame([(r, i) for i, r in enumerate(picks, 1)], "freq_rank long, step long")
    return cand.select("term_id", "name", "freq_rank").join(order, "freq_rank").select("term_id", "name", "step")


def _greedy_picks(sets: list[tuple[list[int], int]], left: set[int], n: int) -> list[int]:
    """``n`` greedy picks among the ranks in ``left``, from the sets of missing ranks."""
    missing = [set(s) for s, _ in sets]
    holders: dict[int, list[int]] = {}
    for i, (s, _) in enumerate(sets):
        for rank in s:
            holders.setdefault(rank, []).append(i)
    gains: dict[int, int] = {}
    for m, (_, w) in zip(missing, sets):
        if len(m) == 1:
            gains[next(iter(m))] = gains.get(next(iter(m)), 0) + w
    rest, picks, taken = iter(sorted(left)), [], set()
    for _ in range(min(n, len(left))):
        pick = min(gains, key=lambda r: (-gains[r], r)) if gains else next(r for r in rest if r not in taken)
        gains.pop(pick, None)
        picks.append(pick)
        taken.add(pick)
        for i in holders.get(pick, ()):
            missing[i].discard(pick)
            if len(missing[i]) == 1:
                only = next(iter(missing[i]))
                gains[only] = gains.get(only, 0) + sets[i][1]
    return picks


def support_thresholds(curves: dict[str, DataFrame], thresholds=THRESHOLDS) -> DataFrame:
    """C4: per threshold the number of terms each strategy needs to support
    that share of the projects (min step with pct >= threshold)."""
    out = None
    for name, curve in curves.items():
        rows = [curve.where(F.col("pct_projects") >= t).agg(F.min("nr_terms").alias(name))
                .select(F.lit(t).alias("threshold"), name) for t in thresholds]
        part = rows[0]
        for r in rows[1:]:
            part = part.unionByName(r)
        out = part if out is None else out.join(part, "threshold")
    return out
