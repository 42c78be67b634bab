"""DuckDB statements for project statistics, table maintenance, outcome
matrix and incremental scans."""

from __future__ import annotations

from . import oracle_history  # noqa: F401  (its tables are used below)
from .oracle import _shares, cte, q

cte("fx_projects", """
SELECT o_custkey AS id, 'c' || CAST(o_custkey AS VARCHAR) AS name,
       CAST(trunc(sum(CAST(o_totalprice AS DECIMAL(18, 2)))) AS BIGINT) AS loc_c, CAST(0 AS BIGINT) AS loc_h,
       CAST(count(*) AS INTEGER) AS commits, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS committers,
       CAST(min(o_orderdate) AS DATE) AS first_commit, CAST(max(o_orderdate) AS DATE) AS last_commit,
       o_custkey % 7 <> 0 AS processed
FROM orders GROUP BY o_custkey""")
cte("fx_projects_f", """
SELECT *, loc_c + loc_h AS loc FROM fx_projects
WHERE processed AND loc_c + loc_h >= 100 AND name NOT IN ('gcc', 'gcc-xtensa', 'gccxml', 'rose')""",
    ["fx_projects"])
q("project_filter", "SELECT id, loc FROM fx_projects_f", ["fx_projects_f"])


def _overview(metric: str, value: str, avg: bool) -> str:
    avg_sql = f"round(avg({value}), 6)" if avg else "CAST(NULL AS DOUBLE)"
    return f"""
SELECT '{metric}' AS metric, CAST(min({value}) AS DOUBLE) AS min_value, CAST(max({value}) AS DOUBLE) AS max_value,
       {avg_sql} AS avg_value,
       (SELECT CAST({value} AS DOUBLE) FROM fx_projects_f ORDER BY loc, id
        LIMIT 1 OFFSET (SELECT count(*) // 2 FROM fx_projects_f)) AS median_by_loc
FROM fx_projects_f"""


_EPOCH = "epoch(CAST({} AS TIMESTAMP))"
q("project_overview", " UNION ALL ".join([
    _overview("loc", "loc", True), _overview("commits", "commits", True),
    _overview("committers", "committers", True),
    _overview("first_commit", _EPOCH.format("first_commit"), False),
    _overview("last_commit", _EPOCH.format("last_commit"), False)]), ["fx_projects_f"])
q("project_vcs_stats", """
SELECT user_id AS project_id, count_if(value <= 50) AS commits, count(DISTINCT event_type) AS committers,
       min(CAST(floor(epoch(ts)) AS BIGINT)) AS first_ts, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last_ts,
       first(CAST(event_id AS VARCHAR) ORDER BY CAST(floor(epoch(ts)) AS BIGINT) DESC,
             CAST(event_id AS VARCHAR) DESC) AS head_hash
FROM events GROUP BY user_id""", [])
q("append_if_absent", """
SELECT p_partkey, p_name, p_type FROM part""", [])
q("flag_where", "SELECT p_partkey, (p_partkey % 3 = 0 OR p_partkey % 2 = 1) AS flag FROM part", [])
q("delete_where", "SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 AND NOT (p_partkey % 3 = 0 OR p_partkey % 2 = 1)", [])
q("delete_where_not_in", "SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 AND (p_partkey % 3 = 0 OR p_partkey % 2 = 1)", [])
q("reject_known", "SELECT p_partkey, p_name FROM part WHERE (p_partkey % 3 = 0 OR p_partkey % 2 = 1) AND p_partkey % 2 <> 0", [])
q("find_duplicates", """
SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""", [])
q("union_distinct", """
SELECT l_orderkey, l_returnflag AS tag FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')
UNION SELECT l_orderkey, 'big' FROM lineitem WHERE l_quantity > 45
UNION SELECT l_orderkey, 'full' FROM lineitem WHERE l_discount = 0""", [])
q("set_difference", """
SELECT p_partkey FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_partkey IS NOT NULL)""", [])
q("semi_join", """
SELECT p_partkey FROM part WHERE p_type IN ('STANDARD BRASS', 'SMALL PLATED COPPER')
  AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)""", [])
q("outcome_matrix", """
SELECT event_type AS tool,
       CAST(count_if(user_id % 4 = 0) AS BIGINT) AS Incorrect,
       CAST(count_if(user_id % 4 = 1) AS BIGINT) AS Missing,
       CAST(count_if(user_id % 4 = 2) AS BIGINT) AS Other_error,
       CAST(count_if(user_id % 4 = 3) AS BIGINT) AS Correct
FROM events GROUP BY event_type""", [])
q("scan_incremental", """
SELECT project_id, term_id, count(*) AS n FROM usages_raw GROUP BY project_id, term_id""", ["usages_raw"])
q("history_incremental", """
SELECT project_id, hash, CAST(sum(delta) AS BIGINT) AS net FROM h_deltas GROUP BY project_id, hash""",
  ["h_deltas"])

# ------------------------------------------------------------------ V17
_EXCL = "name NOT IN (SELECT name FROM excluded_terms)"
_PER = "(SELECT project_id, count(*) AS c FROM usages GROUP BY project_id)"
_PER_U = "(SELECT project_id, count(DISTINCT term_id) AS c FROM usages GROUP BY project_id)"
_DENS = "(SELECT max(loc) // count(*) AS x FROM usages GROUP BY project_id)"
_USED = ("(SELECT t.*, c.term_id IS NOT NULL AS used FROM terms_f t "
         "LEFT JOIN term_counts c ON c.term_id = t.id)")


def _median(expr: str, src: str) -> str:
    return f"(SELECT {expr} FROM {src} m ORDER BY {expr} LIMIT 1 OFFSET (SELECT count(*) // 2 FROM {src} m2))"


METRICS = [
    ("nrTotalTerms", f"SELECT count(*) FROM terms WHERE {_EXCL} AND category IS DISTINCT FROM 'Unknown'"),
    ("nrBuiltins", "SELECT count(*) FROM terms_f"),
    ("nrArchitectureSpecificBuiltins", f"SELECT count(*) FROM terms WHERE {_EXCL} AND machine_specific AND documented"),
    ("nrArchitectureIndependentBuiltins",
     f"SELECT count(*) FROM terms WHERE {_EXCL} AND NOT machine_specific AND documented"),
    ("nrGCCInternalBuiltins", f"SELECT count(*) FROM terms WHERE {_EXCL} AND category = 'GCC internal'"),
    ("nrNotDefBuiltins", "SELECT count(*) FROM terms_f WHERE NOT documented"),
    ("nrUnknownBuiltins", "SELECT count(*) FROM terms WHERE category = 'Unknown'"),
    ("nrDefBuiltins", f"SELECT count(*) FROM terms WHERE {_EXCL} AND documented"),
    ("nrUsedBuiltins", "SELECT count(*) FROM term_counts"),
    ("nrProjectsUnfiltered", "SELECT count(*) FROM usage_projects WHERE processed"),
    ("nrProjects", "SELECT count(*) FROM projects_f"),
    ("totalMLoc", "SELECT sum(loc) // 1000000 FROM projects_f"),
    ("maxNrBuiltinsPerProject", f"SELECT max(c) FROM {_PER}"),
    ("avgNrBuiltinsPerProject", f"SELECT round(avg(c), 6) FROM {_PER}"),
    ("medianNrBuiltinsPerProject", "SELECT " + _median("c", _PER)),
    ("kBuiltins", "SELECT count(*) // 1000 FROM usages"),
    ("kProjectUniqueBuiltins", "SELECT count(*) // 1000 FROM (SELECT DISTINCT project_id, term_id FROM usages)"),
    ("nrProjectsWithBuiltins", "SELECT count(DISTINCT project_id) FROM usages"),
    ("percentageProjectsWithBuiltins",
     "SELECT round(count(DISTINCT project_id) * 100.0 / (SELECT count(*) FROM projects_f), 6) FROM usages"),
    ("percentageFilteredBuiltins",
     "SELECT round(count(*) * 100.0 / (SELECT count(*) FROM usages_raw), 6) FROM usages"),
    ("kBuiltinsUnfiltered", "SELECT count(*) // 1000 FROM usages_raw"),
    ("nrBlacklist", "SELECT count(*) FROM fragments WHERE category = 'MANUAL'"),
    ("builtinsWithLessThanTwoOccurrences", """SELECT count_if(n <= 1) FROM (
        SELECT c.n FROM terms t LEFT JOIN (SELECT term_id, count(DISTINCT project_id) AS n FROM usages
        GROUP BY term_id) c ON c.term_id = t.id WHERE NOT t.documented)"""),
    ("maxNumberUniqueBuiltinsPerProject", f"SELECT max(c) FROM {_PER_U}"),
    ("avgNumberUniqueBuiltinsPerProject", f"SELECT round(avg(c), 6) FROM {_PER_U}"),
    ("medianNumberUniqueBuiltinsPerProject", "SELECT " + _median("c", _PER_U)),
    ("medianBuiltinEveryXLOC", "SELECT " + _median("x", _DENS)),
    ("avgBuiltinEveryXLOC", f"SELECT round(avg(x), 6) FROM {_DENS}"),
    ("minBuiltinEveryXLOC", f"SELECT min(x) FROM {_DENS}"),
    ("maxBuiltinEveryXLOC", f"SELECT max(x) FROM {_DENS}"),
    ("nrProjectsWithMachineIndependentBuiltins",
     "SELECT count(DISTINCT project_id) FROM usages WHERE NOT machine_specific"),
    ("nrProjectsWithMachineSpecificBuiltins", "SELECT count(DISTINCT project_id) FROM usages WHERE machine_specific"),
    ("numberDefBuiltinsUsed", f"SELECT count_if(used) FROM {_USED} WHERE documented"),
    ("numberDefBuiltinsNotUsed", f"SELECT count_if(NOT used) FROM {_USED} WHERE documented"),
    ("percentageDefBuiltinsUsed", f"SELECT round(count_if(used) * 100.0 / count(*), 6) FROM {_USED} WHERE documented"),
    ("nrMachineSpecificBuiltinsUnused", f"SELECT count_if(NOT used) FROM {_USED} WHERE documented AND machine_specific"),
    ("nrMachineIndependentBuiltinsUnused",
     f"SELECT count_if(NOT used) FROM {_USED} WHERE documented AND NOT machine_specific"),
]
_KIND = {"MachineSpecific": "machine_specific", "MachineIndependent": "NOT machine_specific"}
_RAW = "(" + _shares(True) + ")"
METRICS += [
    ("nrFromStars", "SELECT min(stars) FROM projects_f"), ("nrToStars", "SELECT max(stars) FROM projects_f"),
    ("nrKRemovedByDoubleQuotes", f"SELECT nr_quotes // 1000 FROM {_RAW}"),
    ("percentageRemovedByDoubleQuotes", f"SELECT pct_quotes FROM {_RAW}"),
    ("percentageBuiltinFilteredByComments", f"SELECT pct_comment FROM {_RAW}"),
    ("percentageFilteredByCompilerDirectories", f"SELECT pct_vendored FROM {_RAW}"),
    ("percentageFilteredByBlacklist", f"SELECT pct_manual FROM {_RAW}"),
    ("nrOtherBuiltins", "SELECT count(*) FROM terms_f WHERE category = 'other'"),
    ("topMachineSpecificBuiltins", "SELECT count_if(machine_specific) FROM (SELECT * FROM term_counts "
                                   "ORDER BY projects DESC, term_id LIMIT 100)"),
    ("percentageDefBuiltinsNotUsed",
     f"SELECT round(count_if(NOT used) * 100.0 / count(*), 6) FROM {_USED} WHERE documented"),
    ("percentageUnusedMachineSpecificBuiltins",
     f"SELECT count_if(NOT used) * 100.0 / count(*) FROM {_USED} WHERE documented AND machine_specific"),
    ("percentageUnusedMachineIndependetBuiltins",
     f"SELECT count_if(NOT used) * 100.0 / count(*) FROM {_USED} WHERE documented AND NOT machine_specific"),
    ("numberProjectsGitHistoryProcessed",
     "SELECT count(*) FROM projects_f WHERE id IN (SELECT id FROM h_projects WHERE history_checked)"),
    ("numberProjectsNotAnalyzed",
     "SELECT count(*) FROM projects_f WHERE id NOT IN (SELECT id FROM h_projects WHERE history_checked) "
     "AND id IN (SELECT project_id FROM usages)"),
    ("percentageProjectsGitHistoryProcessed",
     "SELECT count(*) * 100.0 / (SELECT count(DISTINCT project_id) FROM usages) FROM projects_f "
     "WHERE id IN (SELECT id FROM h_projects WHERE history_checked)"),
    ("numberProjectsTrendAnalyzed", "SELECT count(*) FROM rated"),
]
METRICS += [(n, f"SELECT count_if(category = '{c}') FROM (SELECT * FROM term_counts ORDER BY projects DESC, term_id LIMIT {k})")
            for n, k, c in [
                ("topOtherBuiltins", 50, "other"), ("topSyncBuiltins", 50, "sync"), ("topAtomicBuiltins", 100, "atomic"),
                ("topOtherLibcBuiltins", 100, "other-libc"), ("topInternalBuiltins", 100, "GCC internal"),
                ("topAddressBuiltins", 100, "address"), ("offsetofBuiltins", 100, "offsetof"),
                ("objectSizeBuiltins", 100, "object-size"), ("overflowBuiltins", 100, "overflow"),
                ("topPowerpcAltivecBuiltins", 100, "powerpc-altivec"), ("topArmCBuiltins", 100, "arm-c-extensions")]]
METRICS += [(f"k{k}BuiltinsTotal", f"SELECT count(*) // 1000 FROM usages WHERE {w}") for k, w in _KIND.items()]
METRICS += [(f"nr{k}BuiltinsUsed", f"SELECT count_if(used) FROM {_USED} WHERE documented AND {w}") for k, w in _KIND.items()]
METRICS += [(f"medianNr{k}BuiltinsPerProject", "SELECT " + _median(
    "c", f"(SELECT count(*) AS c FROM usages WHERE {w} GROUP BY project_id)")) for k, w in _KIND.items()]
METRICS += [(f"medianNumber{k}UniqueBuiltinsPerProject", "SELECT " + _median(
    "c", f"(SELECT count(DISTINCT term_id) AS c FROM usages WHERE {w} GROUP BY project_id)")) for k, w in _KIND.items()]
METRICS += [(n, "SELECT count_if(l = {0}) * 100.0 / count(*) FROM (SELECT count(DISTINCT label) AS l FROM rated "
                "GROUP BY project_id HAVING count(DISTINCT \"user\") = 3)".format(k))
            for k, n in enumerate(["classificationsNrAgreed", "classificationsNrTwoAgreed", "classificationsAllDisagreed"], 1)]
_LISTS = [
    f"""SELECT '{m}' || replace(category, '-', ''), {v} FROM (
  SELECT category, count_if(NOT used AND documented) AS n, count(*) AS a FROM {_USED} GROUP BY category) WHERE n > 0"""
    for m, v in (("nrUnused", "n"), ("percentageUnused", "n * 100.0 / a"))]
_LISTS += [f"SELECT '{m}' || metric, {v} FROM decisions" for m, v in (("nr", "count"), ("percentage", "pct"))]
_LISTS += ["SELECT 'median' || label, median_commits FROM label_medians"]
q("metric_catalogue", "\nUNION ALL\n".join(
    [f"SELECT '{name}' AS metric, round(CAST(({sql}) AS DOUBLE), 6) AS value" for name, sql in METRICS] +
    [f"SELECT m, round(CAST(v AS DOUBLE), 6) FROM ({sql}) t(m, v)" for sql in _LISTS]),
  ["terms", "excluded_terms", "terms_f", "term_counts", "usage_projects", "projects_f", "usages",
   "usages_raw", "fragments", "h_projects", "rated", "decisions", "label_medians"])
q("work_queue", """
SELECT id, loc_c + loc_h AS loc FROM fx_projects WHERE NOT processed ORDER BY loc, id LIMIT 10""",
  ["fx_projects"])
