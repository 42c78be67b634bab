"""Commit history H1-H15 with the series windows W1-W5, W8.

Inputs (schema.py): commits (project_id, hash, message, ts_unix, author,
email), deltas (hash, project_id, delta[, path, line, term_id]), projects
(id, name, owner, first_commit, last_commit, history_checked).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_line, identifiers, sign_symbol
from ..session import cut_lineage
from . import windows
from .joins import broadcast_checked
from .order_stats import quantiles, ranked_values

# Fixed values of the study's trend rules
MIN_COMMITS = 5
FEW_COMMITS_LABEL = "less than 5 commits"
AUTOMATIC = "automatic"
# Change types of a file diff and the event names of a delta
ADD, MODIFY, DELETE = "ADD", "MODIFY", "DELETE"
EVENTS = {"add": "add-file", "plus": "modify-add", "minus": "modify-delete", "delete": "delete-file"}
SOURCE_SUFFIX = r"(?i)\.[ch]$"


# ------------------------------------------------------------------ H1 / H2
def diff_deltas(diffs: DataFrame, terms: DataFrame) -> DataFrame:
    """H1: signed term occurrences from unified-diff text per (commit, file).

    Behind the first hunk header (``@@``), lines starting with ``+`` count +1
    and lines starting with ``-`` count -1, without that marker; context lines
    count nothing. Everything before the first hunk is file header, whatever
    it starts with, so a changed line such as ``--- foo;`` counts. Only C
    sources and headers, in either case: by the new path, for DELETE by the
    old one. The stored path is the new path for ADD and modify-delete rows,
    the old path for modify-add and DELETE rows (as the study stored them);
    line numbers are 0-based positions in the diff text.
    """
    raws = F.split("diff", "\n")
    first_hunk = F.array_position(F.transform(raws, lambda l: l.startswith("@@")), F.lit(True))  # 1-based, 0: none
    source = F.when(F.col("change_type") == DELETE, F.col("old_path")).otherwise(F.col("new_path"))
    d = diffs.where(source.rlike(SOURCE_SUFFIX)).select(
        "project_id", "hash", "change_type", "old_path", "new_path", first_hunk.alias("first_hunk"),
        F.posexplode(raws).alias("line_nr", "raw"))
    ct = F.col("change_type")
    sign = F.when(F.col("raw").startswith("+"), 1).when(F.col("raw").startswith("-"), -1)
    event = (F.when(ct == ADD, EVENTS["add"]).when(ct == DELETE, EVENTS["delete"])
             .when(sign > 0, EVENTS["plus"]).otherwise(EVENTS["minus"]))
    path = F.when((ct == ADD) | ((ct == MODIFY) & (sign < 0)), F.col("new_path")).otherwise(F.col("old_path"))
    lines = (d.where((F.col("first_hunk") > 0) & (F.col("line_nr") >= F.col("first_hunk")))
             .withColumn("delta", sign).where(F.col("delta").isNotNull())
             .select("project_id", "hash", event.alias("event"), path.alias("path"),
                     F.col("delta").cast("int").alias("delta"), F.substring("raw", 2, 1 << 30).alias("line"),
                     F.col("line_nr").cast("int").alias("line_nr")))
    dim = broadcast_checked(terms.select(F.col("name").alias("token"), F.col("id").alias("term_id")))
    return (lines.select("*", F.explode(identifiers("line")).alias("token"))
            .join(dim, "token").drop("token"))


def snapshot_deltas(old_usages: DataFrame, new_usages: DataFrame, key: list[str]) -> DataFrame:
    """H2: net change per (key..., term) = occurrences in the new version
    minus occurrences in the old version: one aggregate of both, the old ones
    counting -1. A NULL in the key equals nothing: both versions keep a row."""
    k = key + ["term_id"]
    sides = [u.select(*k, F.lit(n).cast("long").alias("_n")) for u, n in ((old_usages, -1), (new_usages, 1))]
    apart = F.when(reduce(Column.__or__, [F.col(c).isNull() for c in k]), F.col("_n"))
    return sides[0].unionByName(sides[1]).groupBy(*k, apart.alias("_apart")) \
        .agg(F.sum("_n").alias("delta")).where(F.col("delta") != 0).drop("_apart")


# ------------------------------------------------------------------ H3
def first_parent_chain(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """H3: the first-parent chain of each head: (project_id, hash, commit_nr)
    with commit_nr 1 = head, following ``parent`` until a root.

    Pointer doubling: jump tables anc_{2^i} are built by self-joins
    (log2 of the longest chain rounds), then the chain set doubles per round
    from the head. Each round's result is checkpointed into the shared
    checkpoint folder, so plans stay small and a lost executor recomputes one
    round only.
    """
    edges = commits.select("project_id", "hash", "parent").where(F.col("parent").isNotNull())
    # a parent outside the table ends the chain like a root
    edges = edges.join(commits.select("project_id", F.col("hash").alias("parent")),
                       ["project_id", "parent"], "left_semi")
    # level 0: one step
    jumps = [cut_lineage(edges.select("project_id", "hash", F.col("parent").alias("anc")))]
    longest = jumps[0].count()
    while True:
        if (1 << (len(jumps) - 1)) > longest:  # no chain has that many steps
            raise ValueError("the parent links of some commit form a cycle")
        j = jumps[-1]
        nxt = (j.alias("a").join(j.alias("b"), (F.col("a.project_id") == F.col("b.project_id"))
                                 & (F.col("a.anc") == F.col("b.hash")))
               .select(F.col("a.project_id"), F.col("a.hash"), F.col("b.anc").alias("anc")))
        nxt = cut_lineage(nxt)
        if nxt.limit(1).count() == 0:
            break
        jumps.append(nxt)
    chain = heads.select("project_id", "hash", F.lit(0).cast("long").alias("dist"))
    for i in range(len(jumps) - 1, -1, -1):
        step = 1 << i
        j = jumps[i]
        more = (chain.join(j, ["project_id", "hash"])
                .select("project_id", F.col("anc").alias("hash"), (F.col("dist") + step).alias("dist")))
        chain = cut_lineage(chain.unionByName(more))
    return chain.select("project_id", "hash", (F.col("dist") + 1).cast("int").alias("commit_nr"))


# ------------------------------------------------------------------ H4-H9
def commit_records(commits: DataFrame, deltas: DataFrame) -> DataFrame:
    """H4: commits with at least one delta row, once each."""
    return commits.join(deltas.select("project_id", "hash").distinct(), ["project_id", "hash"], "left_semi")


def commit_net(commits: DataFrame, deltas: DataFrame, tie: str = "hash") -> DataFrame:
    """H5 + W2: per commit the sum of its deltas (NULL when none), and the
    commit number (1 = newest) per project by time, ties by ``tie``."""
    net = deltas.groupBy("project_id", "hash").agg(F.sum("delta").cast("long").alias("net"))
    c = commits.join(net, ["project_id", "hash"], "left")
    return windows.row_number(c, "project_id", "ts_unix", tie, "commit_nr", descending=True)


def usage_series(net: DataFrame, tie: str = "hash") -> DataFrame:
    """Running number of term usages per project over the commits
    with a non-zero net change, in time order."""
    nz = net.where(F.col("net") != 0)
    return windows.running_sum(nz, "project_id", "ts_unix", tie, "net", "nr_terms") \
        .select("project_id", "hash", "ts_unix", "nr_terms")


def series_with_endpoints(series: DataFrame, projects: DataFrame) -> DataFrame:
    """The series plus a first point (first-commit date, 0) and a
    last point (last-commit date, last running total) per project."""
    p = projects.select(F.col("id").alias("project_id"),
                        F.unix_timestamp(F.col("first_commit").cast("timestamp")).alias("first_ts"),
                        F.unix_timestamp(F.col("last_commit").cast("timestamp")).alias("last_ts"))
    last = series.groupBy("project_id").agg(
        F.max_by("nr_terms", F.struct("ts_unix", "hash")).alias("last_total"))
    ends = p.join(last, "project_id")
    first_rows = ends.select("project_id", F.lit(0).alias("seq"), F.col("first_ts").alias("ts_unix"),
                             F.lit(0).cast("long").alias("nr_terms"))
    last_rows = ends.select("project_id", F.lit(2).alias("seq"), F.col("last_ts").alias("ts_unix"),
                            F.col("last_total").alias("nr_terms"))
    mid = series.select("project_id", F.lit(1).alias("seq"), "ts_unix", "nr_terms")
    return first_rows.unionByName(mid).unionByName(last_rows)


def top_commits(net: DataFrame, projects: DataFrame, added: bool = True,
                skip_newest: int = 0, k: int = 15) -> DataFrame:
    """H7: commits that added (removed) most terms: project name, first line
    of the message, net change, commit number; optionally without the
    ``skip_newest`` newest commits of each project."""
    c = net.where(F.col("net").isNotNull())
    if skip_newest:
        c = c.where(F.col("commit_nr") > skip_newest)
    p = broadcast_checked(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")))
    order = [F.col("net").desc() if added else F.col("net").asc(), F.col("project_id"), F.col("hash")]
    top = c.orderBy(*order).limit(k)
    return top.join(p, "project_id", "left").select(
        "project_id", "project_name", "hash", first_line("message").alias("message"), "net", "commit_nr")


def top_committers(net: DataFrame, sign: int = 0, k: int = 20) -> DataFrame:
    """H8: (author, e-mail) with most term-related commits (non-NULL net;
    only additions for sign > 0, deletions for sign < 0) and their projects."""
    c = net
    if sign > 0:
        c = c.where(F.col("net") > 0)
    elif sign < 0:
        c = c.where(F.col("net") < 0)
    g = c.groupBy("author", "email").agg(F.count("net").alias("nr_commits"),
                                         F.countDistinct("project_id").alias("nr_projects"))
    return g.orderBy(F.col("nr_commits").desc(), "author", "email").limit(k)


def commit_lines(deltas: DataFrame) -> DataFrame:
    """H9: sign symbol of every delta row of the commits."""
    return deltas.select("project_id", "hash", sign_symbol("delta").alias("sign"), "delta")


def commit_table(net: DataFrame, project_id: int) -> DataFrame:
    """H9: one project's commits by net change, descending."""
    return net.where(F.col("project_id") == F.lit(project_id)) \
        .select("hash", "ts_unix", "net", "commit_nr").orderBy(F.col("net").desc_nulls_last(), "hash")


# ------------------------------------------------------------------ H10-H15
def analysed_projects(net: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects whose history was checked and that have a non-zero commit."""
    checked = projects.where(F.col("history_checked").eqNullSafe(True)).select(F.col("id").alias("project_id"))
    return net.where(F.col("net") != 0).select("project_id").distinct().join(checked, "project_id", "left_semi")


def trend_features(net: DataFrame, projects: DataFrame) -> DataFrame:
    """Per analysed project every quantity the trend rules need, in one
    aggregation over the running series (H11-H14, W3-W5):

    n (non-zero commits), decreases (negative changes), the global maximum
    and the maximum of the last max(1, int(0.1 n)) points, the value at
    position n div 2 (0-based) and the number of points outside +-10 % of it.
    """
    nz = (net.where(F.col("net") != 0).select("project_id", "hash", "ts_unix", "net")
          .join(analysed_projects(net, projects), "project_id", "left_semi")
          .withColumn("_one", F.lit(1)))
    # running total and position of each point in one chunked pass
    pos = windows.running_sums(nz, "project_id", "ts_unix", "hash", {"nr_terms": "net", "pos": "_one"})
    pos = cut_lineage(pos)  # read three times below
    n = pos.groupBy("project_id").agg(F.count("*").alias("n"))
    p = pos.join(n, "project_id")
    tail = F.greatest(F.lit(1), F.floor(F.col("n") * 0.10).cast("long"))
    p = p.withColumn("in_tail", F.col("pos") > F.col("n") - tail) \
        .withColumn("is_mid", F.col("pos") == F.floor(F.col("n") / 2) + 1)
    f = p.groupBy("project_id", "n").agg(
        F.count_if(F.col("net") < 0).alias("decreases"),
        F.max("nr_terms").alias("max_all"),
        F.max(F.when(F.col("in_tail"), F.col("nr_terms"))).alias("max_tail"),
        F.max(F.when(F.col("is_mid"), F.col("nr_terms"))).alias("mid"))
    outl = p.join(f.select("project_id", "mid"), "project_id").groupBy("project_id").agg(
        F.count_if((F.col("nr_terms") > F.col("mid") * 1.1) | (F.col("nr_terms") < F.col("mid") * 0.9))
        .alias("outside"))
    return f.join(outl, "project_id")


def trend_rules(features: DataFrame) -> DataFrame:
    """H11-H14 as columns: few commits (active rule), monotonic, mostly
    stable, mostly increasing (rules the study disabled, kept available)."""
    return features.select(
        "project_id",
        (F.col("n") < MIN_COMMITS).alias("few_commits"),
        (F.col("decreases") == 0).alias("monotonic"),
        (F.col("outside") < F.col("n") * 0.15).alias("mostly_stable"),
        ((F.col("decreases") < F.col("n") * 0.20) & (F.col("max_all") <= F.col("max_tail")))
        .alias("mostly_increasing"))


def trend_few_commits(net: DataFrame, projects: DataFrame, ratings: DataFrame) -> DataFrame:
    """H11 + K5: analysed projects with fewer than 5 non-zero commits get the
    label ``less than 5 commits`` by ``automatic`` (replacing that user's
    earlier label); returns the new ratings table."""
    few = (net.where(F.col("net") != 0).join(analysed_projects(net, projects), "project_id", "left_semi")
           .groupBy("project_id").agg(F.count("commit_nr").alias("n")).where(F.col("n") < MIN_COMMITS)
           .select("project_id", F.lit(FEW_COMMITS_LABEL).alias("label"), F.lit(AUTOMATIC).alias("user")))
    from .tables import upsert
    return upsert(ratings.select("project_id", "label", "user"), few, ["project_id", "user"])


def median_commits_per_label(net: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per label the true median over its projects of the number of
    non-zero commits (a project rated twice with one label counts once)."""
    per = net.where(F.col("net") != 0).groupBy("project_id").agg(F.count("*").alias("n"))
    lab = ratings.select("project_id", "label").distinct()
    ranked = ranked_values(lab.join(per, "project_id"), {"n": F.col("n")}, ["label"])
    return quantiles(ranked, ["label"], F.col("whole").cast("double"), {"median_commits": 0.5})


def resume_partial(commits: DataFrame, deltas: DataFrame, projects: DataFrame):
    """History rows of projects that are not finished are removed
    (they are redone): returns (commits, deltas) of finished projects."""
    done = projects.where(F.col("history_checked").eqNullSafe(True)).select(F.col("id").alias("project_id"))
    return (commits.join(done, "project_id", "left_semi"), deltas.join(done, "project_id", "left_semi"))
