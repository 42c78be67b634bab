"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import DEFAULT_RULES, STOP_WORDS
from .queries import URL_RULES

_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
_FAILED = ", ".join(f"CASE WHEN {r.metric} {r.fails_if} {r.threshold} THEN '{r.name}' END"
                    for r in DEFAULT_RULES)

QUALITY = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), win AS (
  SELECT rowid_ AS r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS x
  FROM (SELECT row_number() OVER () AS rowid_, w FROM t) q, unnest(range(1, len(w) - 1)) u(i)
), numbered AS (SELECT row_number() OVER () AS r, * FROM t),
rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM (
    SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, x) > 1) a, range(0, 3) b(k)
  GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words
  FROM numbered LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_share
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND concat_ws(',', {_FAILED}) = '' AS kept, n_lines, n_stop_words,
  concat_ws(',', {_FAILED}) AS failed_rules
FROM f
"""

_RULES = ", ".join(f"('{r.action}', '{r.host}', '{r.path}', {i})" for i, r in enumerate(URL_RULES))

URLS = f"""
WITH rules(action, rhost, rpath, i) AS (VALUES {_RULES}),
p AS (
  SELECT page_id, row_number() OVER () AS r,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), best AS (
  SELECT r, arg_max(rhost || rpath, (len(string_split(rhost, '.')), length(rpath))) AS rule,
    arg_max(action, (len(string_split(rhost, '.')), length(rpath))) AS action
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN best USING (r)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT a.vec_id AS query_id,
  (row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.q, b.q) DESC, b.vec_id))::INTEGER AS rank,
  b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
QUALIFY rank <= 5
"""

PHRASES = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) t(k)) GROUP BY ALL
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), parts AS (
  SELECT lang, k, phrase, a, j AS cut_k, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), cut AS (
  SELECT p.*, x.f AS l, y.f AS r, (1000000 * a::HUGEINT * a) // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.first JOIN f y ON y.lang = p.lang AND y.phrase = p.rest
  QUALIFY row_number() OVER (PARTITION BY p.lang, p.phrase ORDER BY score, cut_k) = 1
), held AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3)
  GROUP BY ALL
), total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score::BIGINT AS score
FROM cut LEFT JOIN held USING (lang, phrase) JOIN total USING (lang)
WHERE longest IS NULL OR k = 3 OR 100 * longest < 50 * a
QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op1_quality_rules": QUALITY,
    "op10_url_filter": URLS,
    "op11_topk_search": TOP_K,
    "op13_phrase_mining": PHRASES,
}
