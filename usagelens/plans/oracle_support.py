"""DuckDB statements for the support order and coverage queries."""

from __future__ import annotations

from .oracle import cte, q

cte("needs", """
SELECT DISTINCT l.l_orderkey AS project_id, CAST(substr(p.p_brand, 7) AS BIGINT) AS term_id, p.p_brand AS name,
       CASE WHEN CAST(substr(p.p_brand, 7) AS INTEGER) % 5 = 0 THEN 'libc' ELSE 'other' END AS category,
       CAST(substr(p.p_brand, 7) AS INTEGER) % 2 = 0 AS machine_specific
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""")
cte("freq", """
SELECT term_id, name, category, machine_specific, count(*) AS projects,
       row_number() OVER (ORDER BY count(*) DESC, term_id) AS freq_rank
FROM needs GROUP BY term_id, name, category, machine_specific""", ["needs"])


def _by_frequency(done: str) -> str:
    return f"""
WITH cand AS (SELECT *, row_number() OVER (ORDER BY freq_rank) AS step FROM freq WHERE NOT ({done})),
     ranks AS (SELECT term_id, step FROM cand UNION ALL SELECT term_id, 0 FROM freq WHERE {done}),
     need AS (SELECT n.project_id, max(r.step) AS need FROM needs n JOIN ranks r ON r.term_id = n.term_id
              GROUP BY n.project_id),
     total AS (SELECT count(DISTINCT project_id) AS total FROM needs)
SELECT CAST(c.step AS INTEGER) AS nr_terms, c.name,
       (SELECT count(*) FROM need WHERE need <= c.step) AS supported,
       round((SELECT count(*) FROM need WHERE need <= c.step) * 100.0 / (SELECT total FROM total), 6)
         AS pct_projects,
       'most-frequent' AS decision
FROM cand c"""


q("support_by_frequency", _by_frequency("false"), ["freq", "needs"])
q("support_by_frequency_independent", _by_frequency("machine_specific"), ["freq", "needs"])


def _greedy(done: str) -> str:
    return f"""
WITH RECURSIVE cand AS (SELECT * FROM freq WHERE NOT ({done})),
     start AS (SELECT list(term_id) AS ids FROM freq WHERE {done}),
     total AS (SELECT count(DISTINCT project_id) AS total FROM needs),
     g(step, selected, pick) AS (
       SELECT 0, (SELECT coalesce(ids, []) FROM start), CAST(NULL AS BIGINT)
       UNION ALL
       SELECT g.step + 1, list_append(g.selected, p.term_id), p.term_id
       FROM g, LATERAL (
         SELECT c.term_id FROM cand c
         LEFT JOIN (SELECT max(n.term_id) AS term_id, count(*) AS cnt FROM needs n
                    WHERE NOT list_contains(g.selected, n.term_id) GROUP BY n.project_id) m
           ON m.term_id = c.term_id AND m.cnt = 1
         WHERE NOT list_contains(g.selected, c.term_id)
         GROUP BY c.term_id, c.freq_rank
         ORDER BY count(m.term_id) DESC, c.freq_rank LIMIT 1) p
       WHERE g.step < (SELECT count(*) FROM cand))
SELECT CAST(g.step AS INTEGER) AS nr_terms, c.name,
       (SELECT total FROM total) - (SELECT count(DISTINCT n.project_id) FROM needs n
                                    WHERE NOT list_contains(g.selected, n.term_id)) AS supported,
       round(((SELECT total FROM total) - (SELECT count(DISTINCT n.project_id) FROM needs n
                                           WHERE NOT list_contains(g.selected, n.term_id)))
             * 100.0 / (SELECT total FROM total), 6) AS pct_projects,
       'greedy' AS decision
FROM g JOIN cand c ON c.term_id = g.pick WHERE g.step > 0"""


q("support_greedy", _greedy("false"), ["freq", "needs"])
q("support_greedy_independent", _greedy("machine_specific"), ["freq", "needs"])
cte("curve_freq", _by_frequency("false"), ["freq", "needs"])
cte("curve_greedy", _greedy("false"), ["freq", "needs"])
q("support_thresholds", """
SELECT t.threshold,
       (SELECT min(nr_terms) FROM curve_freq WHERE pct_projects >= t.threshold) AS most_frequent,
       (SELECT min(nr_terms) FROM curve_greedy WHERE pct_projects >= t.threshold) AS greedy
FROM (VALUES (10.0), (50.0), (90.0), (99.0), (99.99)) t(threshold)""", ["curve_freq", "curve_greedy"])
q("start_configuration", """
SELECT cfg AS config, term_id, CASE WHEN done THEN 'implemented' ELSE 'candidate' END AS role FROM (
  SELECT 'libc=0,specific=0' AS cfg, term_id, false AS done FROM freq
  UNION ALL SELECT 'libc=0,specific=1', term_id, machine_specific FROM freq
  UNION ALL SELECT 'libc=1,specific=0', term_id, category = 'libc' FROM freq
  UNION ALL SELECT 'libc=1,specific=1', term_id, machine_specific OR category = 'libc' FROM freq)""",
  ["freq"])

cte("cover_u", """
SELECT p_partkey AS repository, p_size, p_retailprice, p_type, p_brand FROM part""")
cte("cover_s", "SELECT * FROM cover_u WHERE repository % 10 = 0", ["cover_u"])


def _score(u: str, s: str, conds: list[str]) -> str:
    where = " AND ".join(conds)
    return f"""
SELECT (SELECT count(*) FROM {u} u WHERE EXISTS (SELECT 1 FROM {s} s WHERE {where})) AS covered,
       (SELECT count(*) FROM {u}) AS universe,
       round((SELECT count(*) FROM {u} u WHERE EXISTS (SELECT 1 FROM {s} s WHERE {where}))
             / (SELECT count(*) FROM {u}), 6) AS score"""


BAND = {d: f"abs(log10(u.{d} + 1) - log10(s.{d} + 1)) <= 0.5" for d in ("p_size", "p_retailprice")}
EQ = {d: f"u.{d} = s.{d}" for d in ("p_type", "p_brand")}
SD = {d: f"abs(u.{d} - s.{d}) <= (SELECT stddev_samp({d}) FROM cover_u)" for d in ("p_size", "p_retailprice")}
ALL = [BAND["p_size"], BAND["p_retailprice"], EQ["p_type"], EQ["p_brand"]]

q("coverage_score", _score("cover_u", "cover_s", ALL), ["cover_u", "cover_s"])
q("coverage_score_sd", _score("cover_u", "cover_s", [SD["p_size"], SD["p_retailprice"], EQ["p_type"],
                                                     EQ["p_brand"]]), ["cover_u", "cover_s"])
q("coverage_by_dimension", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, score FROM ({_score('cover_u', 'cover_s', [c])})"
    for d, c in [("p_size", BAND["p_size"]), ("p_retailprice", BAND["p_retailprice"]),
                 ("p_type", EQ["p_type"]), ("p_brand", EQ["p_brand"])]), ["cover_u", "cover_s"])
cte("cover_u_brass", "SELECT * FROM cover_u WHERE p_type LIKE '%BRASS'", ["cover_u"])
cte("cover_s_brass", "SELECT * FROM cover_u_brass WHERE repository % 10 = 0", ["cover_u_brass"])
q("coverage_inputs", _score("cover_u_brass", "cover_s_brass", ALL), ["cover_u_brass", "cover_s_brass"])
q("coverage_next", f"""
WITH RECURSIVE sim AS (SELECT u.repository AS a, s.repository AS b FROM cover_u u JOIN cover_u s ON {' AND '.join(ALL)}),
     total AS (SELECT count(*) AS n FROM cover_u),
     g(step, open, added, newly) AS (
       SELECT 0, (SELECT list(u.repository) FROM cover_u u WHERE NOT EXISTS (
                    SELECT 1 FROM cover_s s WHERE {' AND '.join(ALL)})), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
       UNION ALL
       SELECT g.step + 1, list_filter(g.open, lambda x: NOT list_contains(p.bs, x)), p.a, len(p.bs)
       FROM g, LATERAL (SELECT sim.a, list(sim.b) AS bs FROM sim WHERE list_contains(g.open, sim.b)
                        GROUP BY sim.a ORDER BY count(*) DESC, sim.a LIMIT 1) p
       WHERE g.step < 5)
SELECT CAST(step AS INTEGER) AS step, added, newly AS newly_covered,
       round(((SELECT n FROM total) - len(open)) / (SELECT n FROM total), 6) AS score
FROM g WHERE step > 0""", ["cover_u", "cover_s"])
