"""DuckDB statements for the history (H, W) and rating (R, K5) queries."""

from __future__ import annotations

from .oracle import cte, q

# ------------------------------------------------------------------ FX-HISTORY
cte("h_commits", """
SELECT user_id AS project_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS hash,
       event_type || chr(10) || 'value' AS message, CAST(floor(epoch(ts)) AS BIGINT) AS ts_unix,
       event_type AS author, event_type || '@example.org' AS email
FROM events""")
cte("h_deltas", """
SELECT user_id AS project_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS hash,
       CAST(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 WHEN 'error' THEN -2
                            WHEN 'click' THEN 0 END AS INTEGER) AS delta
FROM events WHERE event_type IN ('purchase', 'signup', 'error', 'click')""")
cte("h_projects", """
SELECT user_id AS id, 'p' || CAST(user_id AS VARCHAR) AS name, CAST(min(ts) AS DATE) AS first_commit,
       CAST(max(ts) AS DATE) AS last_commit, user_id % 7 <> 0 AS history_checked
FROM events GROUP BY user_id""")
cte("h_ratings", """
SELECT DISTINCT user_id AS project_id, 'g' || CAST(user_id % 4 AS VARCHAR) AS label, 'rater' AS "user"
FROM events""")
cte("h_net", """
SELECT c.*, d.net,
       CAST(row_number() OVER (PARTITION BY c.project_id ORDER BY c.ts_unix DESC, c.hash DESC) AS INTEGER)
         AS commit_nr
FROM h_commits c LEFT JOIN (SELECT project_id, hash, CAST(sum(delta) AS BIGINT) AS net
                            FROM h_deltas GROUP BY project_id, hash) d
  ON c.project_id = d.project_id AND c.hash = d.hash""", ["h_commits", "h_deltas"])
cte("h_series", """
SELECT project_id, hash, ts_unix,
       CAST(sum(net) OVER (PARTITION BY project_id ORDER BY ts_unix, hash
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS nr_terms
FROM h_net WHERE net <> 0""", ["h_net"])
cte("h_analysed", """
SELECT DISTINCT project_id FROM h_net
WHERE net <> 0 AND project_id IN (SELECT id FROM h_projects WHERE history_checked)""",
    ["h_net", "h_projects"])

q("commit_records", """
SELECT c.project_id, c.hash FROM h_commits c
WHERE EXISTS (SELECT 1 FROM h_deltas d WHERE d.project_id = c.project_id AND d.hash = c.hash)""",
  ["h_commits", "h_deltas"])
q("commit_net", "SELECT project_id, hash, net, commit_nr FROM h_net", ["h_net"])
q("usage_series", "SELECT * FROM h_series", ["h_series"])
q("series_endpoints", """
WITH s AS (SELECT * FROM h_series WHERE project_id IN (SELECT project_id FROM h_analysed)),
     last AS (SELECT project_id, first(nr_terms ORDER BY ts_unix DESC, hash DESC) AS last_total
              FROM s GROUP BY project_id),
     ends AS (SELECT p.id AS project_id,
                     CAST(epoch(CAST(p.first_commit AS TIMESTAMP)) AS BIGINT) AS first_ts,
                     CAST(epoch(CAST(p.last_commit AS TIMESTAMP)) AS BIGINT) AS last_ts, l.last_total
              FROM h_projects p JOIN last l ON l.project_id = p.id)
SELECT project_id, 0 AS seq, first_ts AS ts_unix, CAST(0 AS BIGINT) AS nr_terms FROM ends
UNION ALL SELECT project_id, 1, ts_unix, nr_terms FROM s
UNION ALL SELECT project_id, 2, last_ts, last_total FROM ends""", ["h_series", "h_analysed", "h_projects"])
for _nm, _order, _skip in [("top_commits_added", "DESC", ""),
                           ("top_commits_added_skip_newest", "DESC", "AND commit_nr > 5"),
                           ("top_commits_removed", "ASC", "")]:
    q(_nm, f"""
SELECT t.project_id, p.name AS project_name, t.hash, split_part(t.message, chr(10), 1) AS message,
       t.net, t.commit_nr
FROM (SELECT * FROM h_net WHERE net IS NOT NULL {_skip}
      ORDER BY net {_order}, project_id, hash LIMIT 15) t
LEFT JOIN h_projects p ON p.id = t.project_id""", ["h_net", "h_projects"])
for _nm, _where in [("top_committers", ""), ("top_committers_additions", "WHERE net > 0"),
                    ("top_committers_deletions", "WHERE net < 0")]:
    q(_nm, f"""
SELECT author, email, count(net) AS nr_commits, count(DISTINCT project_id) AS nr_projects
FROM h_net {_where} GROUP BY author, email ORDER BY nr_commits DESC, author, email LIMIT 20""", ["h_net"])
q("commit_lines", """
SELECT project_id, hash, CASE WHEN delta > 0 THEN '+' WHEN delta < 0 THEN '-' END AS sign, delta
FROM h_deltas""", ["h_deltas"])
q("commit_table", "SELECT hash, ts_unix, net, commit_nr FROM h_net WHERE project_id = 1", ["h_net"])
q("trend_rules", """
WITH s AS (SELECT h.project_id, h.hash, h.ts_unix, h.nr_terms, n.net,
                  row_number() OVER (PARTITION BY h.project_id ORDER BY h.ts_unix, h.hash) AS pos
           FROM h_series h JOIN h_net n ON n.project_id = h.project_id AND n.hash = h.hash
           WHERE h.project_id IN (SELECT project_id FROM h_analysed)),
     nn AS (SELECT project_id, count(*) AS n FROM s GROUP BY project_id),
     f AS (SELECT s.project_id, nn.n, count_if(s.net < 0) AS decreases, max(s.nr_terms) AS max_all,
                  max(s.nr_terms) FILTER (WHERE s.pos > nn.n - greatest(1, CAST(floor(nn.n * 0.10) AS BIGINT)))
                    AS max_tail,
                  max(s.nr_terms) FILTER (WHERE s.pos = nn.n // 2 + 1) AS mid
           FROM s JOIN nn ON nn.project_id = s.project_id GROUP BY s.project_id, nn.n),
     o AS (SELECT s.project_id, count_if(s.nr_terms > f.mid * 1.1 OR s.nr_terms < f.mid * 0.9) AS outside
           FROM s JOIN f ON f.project_id = s.project_id GROUP BY s.project_id)
SELECT f.project_id, f.n < 5 AS few_commits, f.decreases = 0 AS monotonic,
       o.outside < f.n * 0.15 AS mostly_stable,
       f.decreases < f.n * 0.20 AND f.max_all <= f.max_tail AS mostly_increasing
FROM f JOIN o ON o.project_id = f.project_id""", ["h_series", "h_net", "h_analysed"])
q("trend_few_commits", """
SELECT project_id, label, "user" FROM h_ratings
UNION ALL
SELECT project_id, 'less than 5 commits', 'automatic' FROM h_net
WHERE net <> 0 AND project_id IN (SELECT project_id FROM h_analysed)
GROUP BY project_id HAVING count(commit_nr) < 5""", ["h_ratings", "h_net", "h_analysed"])
cte("label_medians", """
SELECT r.label, median(c.n) AS median_commits
FROM (SELECT DISTINCT project_id, label FROM h_ratings) r
JOIN (SELECT project_id, count(*) AS n FROM h_net WHERE net <> 0 GROUP BY project_id) c
  ON c.project_id = r.project_id
GROUP BY r.label""", ["h_ratings", "h_net"])
q("median_commits_per_label", "SELECT * FROM label_medians", ["label_medians"])
q("resume_partial", """
WITH done AS (SELECT id FROM h_projects WHERE history_checked),
     c AS (SELECT project_id, count(*) AS nr_commits FROM h_commits WHERE project_id IN (SELECT id FROM done)
           GROUP BY project_id),
     d AS (SELECT project_id, count(*) AS nr_deltas FROM h_deltas WHERE project_id IN (SELECT id FROM done)
           GROUP BY project_id)
SELECT c.project_id, c.nr_commits, d.nr_deltas FROM c LEFT JOIN d ON d.project_id = c.project_id""",
  ["h_projects", "h_commits", "h_deltas"])
q("first_parent_chain", """
WITH RECURSIVE c AS (SELECT o_orderkey AS hash,
                            CASE WHEN o_orderkey > 0 THEN CAST(floor(o_orderkey / 2) AS BIGINT) END AS parent
                     FROM orders),
     chain(hash, commit_nr) AS (
       SELECT max(hash), 1 FROM c
       UNION ALL
       SELECT c.parent, chain.commit_nr + 1 FROM chain JOIN c ON c.hash = chain.hash
       WHERE c.parent IN (SELECT hash FROM c))
SELECT CAST(1 AS BIGINT) AS project_id, hash, CAST(commit_nr AS INTEGER) AS commit_nr FROM chain""", [])

cte("diffs", """
SELECT CAST(regexp_extract(source, '[0-9]+', 0) AS BIGINT) AS project_id, CAST(doc_id AS VARCHAR) AS hash,
       CASE doc_id % 3 WHEN 0 THEN 'ADD' WHEN 1 THEN 'DELETE' ELSE 'MODIFY' END AS change_type,
       CASE WHEN doc_id % 10 = 4 THEN source || '/' || CAST(doc_id AS VARCHAR) || '.cpp'
            ELSE source || '/' || CAST(doc_id AS VARCHAR) || '.c' END AS old_path,
       source || '/' || CAST(doc_id AS VARCHAR) || '.c' AS new_path,
       array_to_string(list_transform(string_split(text, chr(10)),
         lambda l, i: CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 2 AND i % 2 = 1) THEN '+' ELSE '-' END || l),
         chr(10)) AS body
FROM documents""")
cte("diff_lines", """
SELECT * FROM (
  SELECT project_id, hash, change_type, old_path, new_path, raw,
         CASE WHEN starts_with(raw, '+') THEN 1 WHEN starts_with(raw, '-') THEN -1 END AS delta
  FROM (SELECT project_id, hash, change_type, old_path, new_path, unnest(string_split(body, chr(10))) AS raw
        FROM diffs))
WHERE delta IS NOT NULL
  AND regexp_matches(CASE WHEN change_type = 'DELETE' THEN old_path ELSE new_path END, '(?i)\\.[ch]$')""",
    ["diffs"])
q("diff_deltas", """
WITH l AS (SELECT project_id,
                  CASE WHEN change_type = 'ADD' THEN 'add-file' WHEN change_type = 'DELETE' THEN 'delete-file'
                       WHEN delta > 0 THEN 'modify-add' ELSE 'modify-delete' END AS event,
                  CASE WHEN change_type = 'ADD' OR (change_type = 'MODIFY' AND delta < 0) THEN new_path
                       ELSE old_path END AS path,
                  delta, substr(raw, 2) AS line
           FROM diff_lines),
     t AS (SELECT project_id, event, path, delta, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS token
           FROM l)
SELECT t.project_id, t.event, t.path, k.id AS term_id, CAST(sum(t.delta) AS BIGINT) AS delta,
       count(*) AS "rows"
FROM t JOIN terms1 k ON k.name = t.token GROUP BY t.project_id, t.event, t.path, k.id""".replace("\\\\", "\\"),
  ["diff_lines", "terms1"])
q("snapshot_deltas", """
WITH v AS (SELECT CAST(regexp_extract(source, '[0-9]+', 0) AS BIGINT) AS project_id,
                  CAST(doc_id // 2 AS BIGINT) AS file_key, doc_id % 2 = 1 AS is_new,
                  unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS token
           FROM documents),
     c AS (SELECT v.project_id, v.file_key, k.id AS term_id, count_if(is_new) AS n_new,
                  count_if(NOT is_new) AS n_old
           FROM v JOIN terms1 k ON k.name = v.token GROUP BY v.project_id, v.file_key, k.id)
SELECT project_id, file_key, term_id, n_new - n_old AS delta FROM c WHERE n_new <> n_old""", ["terms1"])

# ------------------------------------------------------------------ FX-RATING
cte("rated", """
SELECT project_id, "user", label FROM (
  SELECT l_orderkey AS project_id, CAST(l_linenumber AS VARCHAR) AS "user", l_returnflag AS label,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_returnflag DESC)
           AS rn
  FROM lineitem)
WHERE rn = 1""")
cte("resolved", """
SELECT project_id, count(DISTINCT "user") AS nr_users, count(DISTINCT label) AS nr_labels,
       array_to_string(list_sort(list(DISTINCT label)), ';') AS labels,
       CASE WHEN max(label) FILTER (WHERE "user" = '7') IS NOT NULL THEN '7'
            WHEN count(DISTINCT label) = 1 THEN 'resolved' ELSE 'unresolved' END AS status,
       CASE WHEN max(label) FILTER (WHERE "user" = '7') IS NOT NULL THEN max(label) FILTER (WHERE "user" = '7')
            WHEN count(DISTINCT label) = 1 THEN min(label) END AS final_label
FROM rated GROUP BY project_id""", ["rated"])
cte("sampled", """
SELECT DISTINCT project_id FROM rated
WHERE (project_id * 2654435761) % 4294967296 * 100 < 15 * 4294967296""", ["rated"])

q("ratings_upsert", "SELECT * FROM rated", ["rated"])
q("rater_agreement", """
WITH c AS (SELECT project_id, count(DISTINCT "user") AS nr_users, count(DISTINCT label) AS nr_labels
           FROM rated GROUP BY project_id HAVING count(DISTINCT "user") = 3)
SELECT nr_labels, count(*) AS items, round(count(*) * 100.0 / (SELECT count(*) FROM c), 6) AS pct
FROM c GROUP BY nr_labels""", ["rated"])
q("resolve_ratings", "SELECT * FROM resolved", ["resolved"])
q("sample_items", "SELECT * FROM sampled", ["sampled"])
q("worklist", """
SELECT project_id FROM sampled
WHERE project_id NOT IN (SELECT project_id FROM rated WHERE "user" = '5' OR "user" = '1')""",
  ["sampled", "rated"])
q("worklist_by_label", """
SELECT DISTINCT project_id FROM rated WHERE "user" = '2' AND label = 'R'
  AND project_id IN (SELECT project_id FROM resolved WHERE status = 'unresolved')""", ["rated", "resolved"])
q("label_distribution", "SELECT label, count(*) AS count FROM rated GROUP BY label", ["rated"])
cte("decisions", """
WITH fin AS (SELECT * FROM resolved WHERE final_label IS NOT NULL),
     dec AS (SELECT final_label AS decision, count(*) AS count,
                    count(*) * 100.0 / (SELECT count(*) FROM fin) AS pct FROM fin GROUP BY final_label),
     n AS (SELECT count(DISTINCT project_id) AS n FROM rated),
     parts AS (
       SELECT decision, count, pct FROM dec
       UNION ALL
       SELECT label, count(*), count(*) * 100.0 / (SELECT n FROM n) FROM rated WHERE "user" = '1' GROUP BY label
       UNION ALL
       SELECT 'not automatic', count(*), count(*) * 100.0 / (SELECT n FROM n) FROM rated WHERE "user" = '2'
       UNION ALL
       SELECT 'increasing', sum(count), sum(pct) FROM dec WHERE decision IN ('A') HAVING count(*) > 0
       UNION ALL
       SELECT 'stagnant', sum(count), sum(pct) FROM dec WHERE decision IN ('R') HAVING count(*) > 0)
SELECT DISTINCT decision, CAST(count AS BIGINT) AS count, round(pct, 6) AS pct,
       replace(regexp_replace(decision, '[ ,]', '', 'g'), '5', 'five') AS metric
FROM parts""", ["resolved", "rated"])
q("decision_summary", "SELECT * FROM decisions", ["decisions"])
q("ratings_of", """
SELECT project_id, string_agg("user" || '=' || label, ';' ORDER BY "user", label) AS ratings,
       count(*) = 1 AS single
FROM rated GROUP BY project_id""", ["rated"])
