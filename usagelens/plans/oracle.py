"""Independent SQL statements of every registered query, for DuckDB.

The fixture bindings and the operator semantics are restated here in plain
SQL (DuckDB dialect) as a library of named CTEs with dependencies; each
oracle query names the CTEs it needs and only those are emitted.
"""

from __future__ import annotations

CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, sql: str, deps: list[str] | None = None) -> None:
    CTES[name] = (sql, deps or [])


def with_ctes(body: str, needs: list[str]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    stripped = body.lstrip()
    recursive = stripped.upper().startswith("WITH RECURSIVE ")
    head = ("WITH RECURSIVE " if recursive else "WITH ") + \
        ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in order)
    if recursive:
        return head + ",\n" + stripped[len("WITH RECURSIVE "):]
    if stripped[:5].upper() == "WITH ":
        return head + ",\n" + stripped[5:]
    return head + "\n" + body


VENDORED = "({p} ILIKE '%/gcc%/%' OR {p} ILIKE '%/llvm%/%' OR {p} ILIKE '%/clang%/%')"


def vendored(p: str) -> str:
    return VENDORED.format(p=p)


# ------------------------------------------------------------------ FX-USAGE
cte("files", """
SELECT CAST(regexp_extract(source, '[0-9]+', 0) AS BIGINT) AS project_id,
       source || '/' || (CASE WHEN lang = 'de' THEN 'gcc-de' ELSE lang END) || '/'
              || CAST(doc_id AS VARCHAR) || '.c' AS path,
       text AS content, doc_id, source, lang
FROM documents""")
cte("lines", """
SELECT project_id, path, CAST(line_nr AS INTEGER) AS line_nr, line FROM (
  SELECT project_id, path, unnest(arr) AS line, generate_subscripts(arr, 1) AS line_nr, len(arr) AS n
  FROM (SELECT project_id, path, regexp_split_to_array(content, '\\r\\n|\\n|\\r') AS arr FROM files))
WHERE NOT (line_nr = n AND line = '')""".replace("\\\\", "\\"), ["files"])
cte("tokens", """
SELECT project_id, path, line_nr, line, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS token
FROM lines""", ["lines"])
cte("names", """
SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM benchmark""")
cte("terms0", """
SELECT CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS id, name,
       'len' || CAST(length(name) AS VARCHAR) AS category,
       length(name) % 2 = 1 AS machine_specific,
       'https://docs.example.org/len' || CAST(length(name) AS VARCHAR) AS doc_url,
       '6.' || CAST(length(name) AS VARCHAR) || ' Length ' || CAST(length(name) AS VARCHAR)
            || ' Built-in Functions' AS header,
       length(name) % 5 <> 0 AS documented
FROM names""", ["names"])
cte("internal", """
SELECT DISTINCT token AS name FROM tokens
WHERE path LIKE 'src0/%' AND regexp_matches(token, '^Th[a-z]')
  AND token NOT IN (SELECT name FROM terms0)""", ["tokens", "terms0"])
cte("terms1", """
SELECT * FROM terms0
UNION ALL
SELECT (SELECT coalesce(max(id), 0) FROM terms0) + row_number() OVER (ORDER BY name), name,
       'GCC internal', false, '-', 'Internal GCC builtins', false
FROM internal""", ["terms0", "internal"])
cte("scanned", """
SELECT t.project_id, t.path, t.line_nr, t.line, t.token AS term, k.id AS term_id
FROM tokens t LEFT JOIN terms1 k ON t.token = k.name
WHERE k.id IS NOT NULL OR regexp_matches(t.token, '^Th[a-z]')""", ["tokens", "terms1"])
cte("unknown", "SELECT DISTINCT term AS name FROM scanned WHERE term_id IS NULL", ["scanned"])
cte("terms", """
SELECT * FROM terms1
UNION ALL
SELECT (SELECT max(id) FROM terms1) + row_number() OVER (ORDER BY name), name,
       'Unknown', false, NULL, NULL, false
FROM unknown""", ["terms1", "unknown"])
cte("manual_marks", """
SELECT path FROM files WHERE doc_id % 50 = 0""", ["files"])
cte("usages_raw", """
SELECT s.project_id, s.path, s.line_nr, s.line, coalesce(s.term_id, k.id) AS term_id,
       s.path IN (SELECT path FROM manual_marks) AS excluded
FROM scanned s LEFT JOIN terms k ON s.term = k.name""", ["scanned", "terms", "manual_marks"])
cte("auto_fragments", f"""
SELECT line, term_id, category FROM (
  SELECT p.line, p.term_id,
         CASE WHEN regexp_matches(p.line, '//.*' || k.name)
                OR regexp_matches(p.line, '/\\*[^*]*' || k.name)
                OR regexp_matches(p.line, '^[ \\t]*\\* ') THEN 'COMMENT'
              WHEN regexp_matches(p.line, '".*' || k.name || '.*"') THEN 'QUOTES' END AS category
  FROM (SELECT DISTINCT line, term_id FROM usages_raw WHERE NOT {vendored('path')}) p
  JOIN terms k ON p.term_id = k.id)
WHERE category IS NOT NULL""".replace("\\\\", "\\"), ["usages_raw", "terms"])
cte("fragments", f"""
SELECT * FROM (
  SELECT line, term_id, category FROM auto_fragments
  UNION ALL
  SELECT f.line, f.term_id, 'MANUAL' FROM (SELECT DISTINCT line, term_id FROM usages_raw WHERE excluded) f
  WHERE NOT EXISTS (SELECT 1 FROM auto_fragments a WHERE a.line = f.line AND a.term_id = f.term_id)
    AND f.line NOT IN (SELECT line FROM auto_fragments))
WHERE line IN (SELECT line FROM usages_raw WHERE NOT {vendored('path')})""",
    ["auto_fragments", "usages_raw"])
cte("usages_marked", """
SELECT u.project_id, u.path, u.line_nr, u.line, u.term_id,
       u.excluded OR EXISTS (SELECT 1 FROM fragments f WHERE f.line = u.line AND f.term_id = u.term_id)
         AS excluded
FROM usages_raw u""", ["usages_raw", "fragments"])
cte("usage_projects", """
SELECT CAST(regexp_extract(source, '[0-9]+', 0) AS BIGINT) AS id, source AS name,
       'https://github.com/owner/' || source AS url,
       CAST(CAST(regexp_extract(source, '[0-9]+', 0) AS BIGINT) * 7 % 100 AS INTEGER) AS stars,
       CAST(sum(n_chars) AS BIGINT) AS loc_c, CAST(0 AS BIGINT) AS loc_h, true AS processed
FROM documents GROUP BY source""")
cte("projects_f", """
SELECT *, loc_c + loc_h AS loc FROM usage_projects
WHERE processed AND loc_c + loc_h >= 100 AND name NOT IN ('gcc', 'gcc-xtensa', 'gccxml', 'rose')""",
    ["usage_projects"])
cte("excluded_terms", "SELECT name, 'len3' AS reason FROM names WHERE length(name) = 3", ["names"])
cte("terms_f", """
SELECT * FROM terms WHERE name NOT IN (SELECT name FROM excluded_terms)
  AND category IS DISTINCT FROM 'Unknown'""", ["terms", "excluded_terms"])
cte("synonyms", """
SELECT name, CASE WHEN length(name) <= 4 THEN 'short' ELSE 'long' END AS synonym FROM names""",
    ["names"])
cte("usages", f"""
SELECT u.project_id, u.path, u.line_nr, u.line, u.term_id, p.loc, p.url, p.name AS project_name,
       t.name AS term_name, t.category, t.machine_specific, t.documented, t.header
FROM usages_marked u JOIN projects_f p ON u.project_id = p.id JOIN terms_f t ON u.term_id = t.id
WHERE NOT {vendored('u.path')} AND NOT u.excluded""", ["usages_marked", "projects_f", "terms_f"])
cte("term_counts", """
SELECT term_id, term_name, category, machine_specific, count(DISTINCT project_id) AS projects
FROM usages GROUP BY term_id, term_name, category, machine_specific""", ["usages"])
cte("nr_projects", "SELECT count(DISTINCT project_id) AS nr_projects FROM usages", ["usages"])


def upper_median_sql(value: str, source: str) -> str:
    """Value at offset n div 2 of the ascending order (a scalar subquery)."""
    return (f"(SELECT {value} FROM {source} ORDER BY {value} "
            f"LIMIT 1 OFFSET (SELECT count(*) // 2 FROM {source}))")


ORACLE: dict[str, str] = {}


def q(name: str, body: str, needs: list[str]) -> None:
    ORACLE[name] = with_ctes(body, needs)


q("scan_terms", "SELECT project_id, path, line_nr, term_id, excluded FROM usages_raw", ["usages_raw"])
q("discover_terms", "SELECT name FROM internal", ["internal"])
q("unknown_terms", "SELECT id, name FROM terms WHERE category = 'Unknown'", ["terms"])
q("count_pattern", """
SELECT p.project_id, count(t.token) AS nr_asm
FROM (SELECT DISTINCT CAST(regexp_extract(source, '[0-9]+', 0) AS BIGINT) AS project_id FROM documents) p
LEFT JOIN (SELECT project_id, token FROM tokens WHERE token IN ('the')) t USING (project_id)
GROUP BY p.project_id""",
  ["tokens"])
q("config_flags", """
SELECT project_id, true AS has_makefile, bool_or(contains(line, 'token = ')) AS freestanding,
       bool_or(contains(line, '@')) AS no_builtin
FROM (SELECT CAST(regexp_extract(source, '[0-9]+', 0) AS BIGINT) AS project_id,
             unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line
      FROM documents)
GROUP BY project_id""", [])
q("extract_names", """
SELECT DISTINCT unnest(regexp_extract_all(html, '<[a-z][a-z0-9]*')) AS name FROM pages""", [])
q("classify_fragments", "SELECT line, term_id, category FROM auto_fragments", ["auto_fragments"])
q("sync_manual", "SELECT line, term_id, category FROM fragments", ["fragments"])
q("mark_excluded", """
SELECT project_id, count(*) AS nr_usages, count_if(excluded) AS nr_excluded
FROM usages_marked GROUP BY project_id""", ["usages_marked"])
q("vendored_usages", f"""
SELECT project_id, count_if({vendored('path')}) AS nr_vendored, count(*) AS nr_usages
FROM usages_raw GROUP BY project_id""", ["usages_raw"])
q("filtered_usages", """
SELECT project_id, term_id, count(*) AS n FROM usages GROUP BY project_id, term_id""", ["usages"])


def _shares(by_term: bool) -> str:
    if by_term:
        frag = "SELECT DISTINCT ON (line, term_id) line, term_id, category AS cat FROM fragments"
        on = "f.line = u.line AND f.term_id = u.term_id"
    else:
        frag = ("SELECT line, arg_min(category, CASE category WHEN 'COMMENT' THEN 0 WHEN 'QUOTES' "
                "THEN 1 ELSE 2 END) AS cat FROM fragments GROUP BY line")
        on = "f.line = u.line"
    reasons = ["project", "term", "vendored", "comment", "quotes", "manual", "kept"]
    cols = ", ".join(f"count_if(reason = '{r}') AS nr_{r}, "
                     f"round(count_if(reason = '{r}') * 100.0 / count(*), 6) AS pct_{r}"
                     for r in reasons)
    return f"""
SELECT count(*) AS nr_raw, {cols} FROM (
  SELECT CASE WHEN p.id IS NULL THEN 'project' WHEN t.id IS NULL THEN 'term'
              WHEN {vendored('u.path')} THEN 'vendored'
              WHEN f.cat = 'COMMENT' THEN 'comment' WHEN f.cat = 'QUOTES' THEN 'quotes'
              WHEN f.cat = 'MANUAL' OR u.excluded THEN 'manual' ELSE 'kept' END AS reason
  FROM usages_raw u LEFT JOIN ({frag}) f ON {on}
  LEFT JOIN projects_f p ON u.project_id = p.id LEFT JOIN terms_f t ON u.term_id = t.id)"""


q("exclusion_shares", _shares(True), ["usages_raw", "fragments", "projects_f", "terms_f"])
q("exclusion_shares_legacy", _shares(False), ["usages_raw", "fragments", "projects_f", "terms_f"])
q("rare_undocumented", """
SELECT count_if(n <= 1) AS nr_rare FROM (
  SELECT t.id, c.n FROM terms t LEFT JOIN
    (SELECT term_id, count(DISTINCT project_id) AS n FROM usages GROUP BY term_id) c
    ON c.term_id = t.id WHERE NOT t.documented)""", ["terms", "usages"])
q("unique_usages", """
SELECT DISTINCT project_id, term_id, term_name, category, machine_specific FROM usages""", ["usages"])
q("term_counts", "SELECT * FROM term_counts", ["term_counts"])
for _ms, _nm in [(True, "specific"), (False, "independent")]:
    q(f"category_counts_{_nm}", f"""
SELECT category, count(DISTINCT project_id) AS projects FROM usages
WHERE machine_specific = {str(_ms).lower()} GROUP BY category""", ["usages"])
for _u, _nm, _cnt in [(True, "projects_by_unique_terms", "count(DISTINCT term_id)"),
                      (False, "projects_by_usages", "count(*)")]:
    q(_nm, f"""
SELECT project_id, any_value(url) AS url, CAST(any_value(loc) // 1000 AS BIGINT) AS kloc, {_cnt} AS count
FROM usages GROUP BY project_id ORDER BY count DESC, project_id LIMIT 15""", ["usages"])
for _ms, _nm in [(True, "specific"), (False, "independent")]:
    q(f"category_usage_table_{_nm}", f"""
WITH t AS (SELECT k.*, c.term_id IS NOT NULL AS used FROM terms_f k
           LEFT JOIN term_counts c ON c.term_id = k.id WHERE k.machine_specific = {str(_ms).lower()}),
     unfound AS (SELECT category, count(*) AS unfound FROM t WHERE NOT used AND documented GROUP BY category)
SELECT g.category, g.header, g.nr_terms,
       round(CASE WHEN u.unfound IS NULL THEN 100.0 ELSE 100.0 - u.unfound * 100.0 / g.nr_terms END, 6)
         AS pct_used
FROM (SELECT category, header, count(name) AS nr_terms FROM t GROUP BY category, header) g
LEFT JOIN unfound u ON u.category = g.category""", ["terms_f", "term_counts"])
q("unused_by_category", """
WITH t AS (SELECT k.*, c.term_id IS NULL AND k.documented AS unused FROM terms_f k
           LEFT JOIN term_counts c ON c.term_id = k.id),
     g AS (SELECT category, count_if(unused) AS nr_unused, count(*) AS nr_terms,
                  list_sort(list(name) FILTER (WHERE unused)) AS names FROM t GROUP BY category)
SELECT category, nr_unused, round(nr_unused * 100.0 / nr_terms, 6) AS pct_unused,
       CASE WHEN len(names) <= 1 THEN names[1]
            ELSE array_to_string(names[1:len(names) - 1], ', ') || ', and ' || names[len(names)] END
         AS unused_names
FROM g WHERE nr_unused > 0""", ["terms_f", "term_counts"])
q("top_terms", """
SELECT c.term_id, c.term_name, c.category, s.synonym, c.projects,
       round(c.projects * 100.0 / n.nr_projects, 6) AS pct_projects
FROM (SELECT * FROM term_counts ORDER BY projects DESC, term_id LIMIT 10) c
LEFT JOIN synonyms s ON s.name = c.term_name CROSS JOIN nr_projects n""",
  ["term_counts", "synonyms", "nr_projects"])
q("synonym_breakdown", """
SELECT s.synonym, count(*) AS nr_terms, max(c.projects) AS max_projects,
       CAST(sum(c.projects) AS BIGINT) AS sum_projects
FROM term_counts c JOIN synonyms s ON s.name = c.term_name GROUP BY s.synonym""",
  ["term_counts", "synonyms"])
q("top_file_names", """
WITH per AS (SELECT project_id, regexp_extract(path, '[^/]*$', 0) AS file_name,
                    count(DISTINCT term_name) AS n_terms,
                    array_to_string(list_sort(list(DISTINCT term_name)), ',') AS term_set
             FROM usages GROUP BY project_id, file_name),
     sets AS (SELECT file_name, term_set, count(*) AS n FROM per GROUP BY file_name, term_set),
     best AS (SELECT file_name, count(*) AS nr_sets, arg_min(term_set, (-n, term_set)) AS top_set
              FROM sets GROUP BY file_name),
     top_files AS (SELECT file_name, round(avg(n_terms), 6) AS avg_terms, count(*) AS projects
               FROM per GROUP BY file_name ORDER BY projects DESC, file_name LIMIT 10)
SELECT f.file_name, f.avg_terms, f.projects, b.nr_sets, b.top_set
FROM top_files f JOIN best b ON b.file_name = f.file_name""", ["usages"])
q("usage_density", f"""
WITH per AS (SELECT project_id, CAST(max(loc) // count(*) AS BIGINT) AS every_x FROM usages GROUP BY project_id)
SELECT min(every_x) AS min_every_x, max(every_x) AS max_every_x, round(avg(every_x), 6) AS avg_every_x,
       {upper_median_sql('every_x', 'per')} AS median_every_x
FROM per""", ["usages"])


def _distribution(unique: bool, ms: bool | None) -> str:
    cnt = "count(DISTINCT term_id)" if unique else "count(*)"
    where = "" if ms is None else f"WHERE machine_specific = {str(ms).lower()}"
    return f"""
WITH per AS (SELECT project_id, {cnt} AS count FROM usages {where} GROUP BY project_id)
SELECT max(count) AS max_count, round(avg(count), 6) AS avg_count,
       {upper_median_sql('count', 'per')} AS median_count
FROM per"""


for _u in (False, True):
    for _ms, _sfx in [(None, ""), (True, "_specific"), (False, "_independent")]:
        q(f"usage_distribution{'_unique' if _u else ''}{_sfx}", _distribution(_u, _ms), ["usages"])

cte("boxplot_rows_unique", """
WITH g AS (SELECT project_id, CASE WHEN machine_specific THEN 'machine-specific'
                                   ELSE 'machine-independent' END AS kind, count(DISTINCT term_id) AS count
           FROM usages GROUP BY project_id, kind)
SELECT project_id, kind, count FROM g
UNION ALL SELECT project_id, 'total', CAST(sum(count) AS BIGINT) FROM g GROUP BY project_id""", ["usages"])
cte("boxplot_rows_all", """
WITH g AS (SELECT project_id, CASE WHEN machine_specific THEN 'machine-specific'
                                   ELSE 'machine-independent' END AS kind, count(*) AS count
           FROM usages GROUP BY project_id, kind)
SELECT project_id, kind, count FROM g
UNION ALL SELECT project_id, 'total', CAST(sum(count) AS BIGINT) FROM g GROUP BY project_id""", ["usages"])
q("boxplot_rows", "SELECT * FROM boxplot_rows_unique", ["boxplot_rows_unique"])
q("boxplot_summary", """
WITH r AS (SELECT kind, log10(count) AS lx FROM boxplot_rows_all),
     qq AS (SELECT kind, quantile_cont(lx, 0.25) AS q1, quantile_cont(lx, 0.5) AS median,
                   quantile_cont(lx, 0.75) AS q3 FROM r GROUP BY kind),
     j AS (SELECT r.kind, r.lx, qq.q1, qq.median, qq.q3,
                  r.lx >= qq.q1 - 1.5 * (qq.q3 - qq.q1) AND r.lx <= qq.q3 + 1.5 * (qq.q3 - qq.q1) AS inside
           FROM r JOIN qq ON r.kind = qq.kind)
SELECT kind, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(lx) FILTER (WHERE inside), 6) AS lower, round(max(lx) FILTER (WHERE inside), 6) AS upper,
       count_if(NOT inside) AS outliers, count(*) AS n
FROM j GROUP BY kind, q1, median, q3""", ["boxplot_rows_all"])
for _k in (50, 100):
    q(f"top_{_k}_composition", f"""
SELECT category, machine_specific, count(*) AS nr_in_top
FROM (SELECT * FROM term_counts ORDER BY projects DESC, term_id LIMIT {_k})
GROUP BY category, machine_specific""", ["term_counts"])
