"""Registered queries of the history (H, W) and rating (R, K5) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import ratings as R
from ..operators import scan, tables
from ..sources.files import balance, explode_lines
from ..sources.sinks import materialise
from . import fixtures as fx
from .queries import register, study

_HIST: dict = {}
_RATED: dict = {}


def hist(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _HIST:
        i = fx.history_inputs(spark, sf)
        # the per-commit view every history query starts from, materialised once
        _HIST[key] = (i, materialise(H.commit_net(i.commits, i.deltas), "commit_net"))
    return _HIST[key]


@register("commit_records")
def q_commit_records(spark, sf):
    i, _ = hist(spark, sf)
    return H.commit_records(i.commits, i.deltas).select("project_id", "hash")


@register("commit_net")
def q_commit_net(spark, sf):
    _, net = hist(spark, sf)
    return net.select("project_id", "hash", "net", "commit_nr")


@register("usage_series")
def q_usage_series(spark, sf):
    _, net = hist(spark, sf)
    return H.usage_series(net)


@register("series_endpoints")
def q_series_endpoints(spark, sf):
    i, net = hist(spark, sf)
    series = H.usage_series(net).join(H.analysed_projects(net, i.projects), "project_id", "left_semi")
    return H.series_with_endpoints(series, i.projects)


for _nm, _add, _skip in [("top_commits_added", True, 0), ("top_commits_added_skip_newest", True, 5),
                         ("top_commits_removed", False, 0)]:
    register(_nm)(lambda spark, sf, _add=_add, _skip=_skip: H.top_commits(
        hist(spark, sf)[1], hist(spark, sf)[0].projects, _add, _skip, 15))

for _nm, _sign in [("top_committers", 0), ("top_committers_additions", 1), ("top_committers_deletions", -1)]:
    register(_nm)(lambda spark, sf, _sign=_sign: H.top_committers(hist(spark, sf)[1], _sign, 20))


@register("commit_lines")
def q_commit_lines(spark, sf):
    i, _ = hist(spark, sf)
    return H.commit_lines(i.deltas)


@register("commit_table")
def q_commit_table(spark, sf):
    _, net = hist(spark, sf)
    return H.commit_table(net, 1)


@register("trend_rules")
def q_trend_rules(spark, sf):
    i, net = hist(spark, sf)
    return H.trend_rules(H.trend_features(net, i.projects))


@register("trend_few_commits")
def q_trend_few(spark, sf):
    i, net = hist(spark, sf)
    return H.trend_few_commits(net, i.projects, i.ratings)


@register("median_commits_per_label")
def q_median_commits(spark, sf):
    i, net = hist(spark, sf)
    return H.median_commits_per_label(net, i.ratings)


@register("resume_partial")
def q_resume(spark, sf):
    i, _ = hist(spark, sf)
    c, d = H.resume_partial(i.commits, i.deltas, i.projects)
    nd = d.groupBy("project_id").agg(F.count("*").alias("nr_deltas"))
    return c.groupBy("project_id").agg(F.count("*").alias("nr_commits")).join(nd, "project_id", "left")


@register("first_parent_chain")
def q_chain(spark, sf):
    c = fx.chain(spark, sf)
    heads = c.groupBy("project_id").agg(F.max("hash").alias("hash"))
    return H.first_parent_chain(c, heads)


@register("diff_deltas")
def q_diff_deltas(spark, sf):
    s = study(spark, sf)
    return H.diff_deltas(fx.file_diffs(spark, sf), s.known_terms) \
        .groupBy("project_id", "event", "path", "term_id").agg(F.sum("delta").alias("delta"),
                                                               F.count("*").alias("rows"))


@register("snapshot_deltas")
def q_snapshot(spark, sf):
    s = study(spark, sf)
    old, new = fx.snapshot_versions(spark, sf)
    scan_old = scan.scan_terms(explode_lines(balance(old)), s.known_terms, None)
    scan_new = scan.scan_terms(explode_lines(balance(new)), s.known_terms, None)
    return H.snapshot_deltas(scan_old, scan_new, ["project_id", "file_key"])


# ----------------------------------------------------------------- ratings
def rated(spark, sf):
    """The ratings after the upsert, materialised once per data set."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RATED:
        raw = fx.ratings(spark, sf)
        empty = raw.select("project_id", "user", "label").limit(0)
        _RATED[key] = materialise(tables.upsert(empty, raw, ["project_id", "user"]), "rated")
    return _RATED[key]


@register("ratings_upsert")
def q_ratings_upsert(spark, sf):
    return rated(spark, sf)


@register("rater_agreement")
def q_agreement(spark, sf):
    return R.rater_agreement(rated(spark, sf), 3)


@register("resolve_ratings")
def q_resolve(spark, sf):
    return R.resolve_ratings(rated(spark, sf), fx.RESOLVER_RATER)


@register("sample_items")
def q_sample(spark, sf):
    return R.sample_items(rated(spark, sf).select("project_id").distinct(), 15)


@register("worklist")
def q_worklist(spark, sf):
    r = rated(spark, sf)
    items = r.select("project_id").distinct()
    return R.worklist(items, r, user="5", subset=R.sample_items(items, 15), automatic=fx.AUTOMATIC_RATER)


@register("worklist_by_label")
def q_worklist_label(spark, sf):
    r = rated(spark, sf)
    return R.worklist(r.select("project_id").distinct(), r, user="2", label="R",
                      status=R.UNRESOLVED, automatic=fx.AUTOMATIC_RATER, resolver=fx.RESOLVER_RATER)


@register("label_distribution")
def q_labels(spark, sf):
    return R.label_distribution(rated(spark, sf))


@register("decision_summary")
def q_decisions(spark, sf):
    r = rated(spark, sf)
    n = r.select("project_id").distinct().agg(F.count("*").alias("n"))
    return R.decision_summary(r, n, fx.RATING_FAMILIES, fx.RESOLVER_RATER, fx.AUTOMATIC_RATER,
                              fx.MASS_RATER)


@register("ratings_of")
def q_ratings_of(spark, sf):
    return R.ratings_of(rated(spark, sf))
