"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, '.' || host AS dotted FROM split
), found AS (
  SELECT page_id, host, path, dotted, CASE
    WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ends_with(dotted, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ends_with(dotted, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ends_with(dotted, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM ruled
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN ends_with(dotted, '.spam-farm.example.org') OR ends_with(dotted, '.cheap-pills.example.com') THEN 'block'
    ELSE 'allow' END AS verdict
FROM found
"""

OP7 = r"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), esc AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '### ', '##\# '), '</turn>', '<\/turn>'), '<+>', '<\+>') AS etext,
         replace(replace(replace(replace(replace(role, '\', '\\'), '### ', '##\# '), '</turn>', '<\/turn>'), '<+>', '<\+>'), ': ', ':\ ') AS erole,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before_role,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(etext) + CASE WHEN k > 1 AND before_role = role THEN 3 ELSE length('### : </turn>') + 1 + length(erole) END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""

OP10 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT rid, doc_id, lang, source, text,
         regexp_extract_all(text, '[^ \t\n\x0B\x0C\r]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\x0C\r]')) AS lines
  FROM docs
), pos AS (
  SELECT rid, unnest(words) AS w0, unnest(range(len(words))) AS i FROM split
), runs AS (
  SELECT rid, i, w0, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM pos WINDOW o AS (PARTITION BY rid ORDER BY i)
), grams AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w0, w1, w2) AS n FROM runs WHERE w2 IS NOT NULL
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n >= 2) GROUP BY rid
), f AS (
  SELECT s.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[ \t\n\x0B\x0C\r]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN covered c ON s.rid = c.rid
), m AS (
  SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols * 10000 // word_chars ELSE 0 END AS m1,
         CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END AS m2,
         CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END AS m3,
         CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS m4
  FROM f
), long AS (
  SELECT lang, source, unnest([1, 2, 3, 4]) AS k, unnest([m1, m2, m3, m4]) AS v FROM m WHERE NOT base_failed
), buckets AS (
  SELECT lang, source, k, v - v % (CAST(1 AS BIGINT) << greatest(length(bin(v)) - 7, 0)) AS b FROM long
), levels AS (
  SELECT 0 AS level, lang, source, k, b, count(*) AS n FROM buckets GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, k, b, count(*) FROM buckets GROUP BY lang, k, b
  UNION ALL SELECT 2, NULL, NULL, k, b, count(*) FROM buckets GROUP BY k, b
), cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, k) AS total,
         sum(n) OVER (PARTITION BY level, lang, source, k ORDER BY b ROWS UNBOUNDED PRECEDING) AS upto FROM levels
), quart AS (
  SELECT level, lang, source, k, max(total) AS total, min(b) FILTER (WHERE upto * 4 >= total) AS q1,
         min(b) FILTER (WHERE upto * 4 >= total * 2) AS q2, min(b) FILTER (WHERE upto * 4 >= total * 3) AS q3
  FROM cum GROUP BY level, lang, source, k
), fence AS (
  SELECT level, lang, source, max(total) AS total,
         max(CASE WHEN k = 1 THEN q2 + 4 * greatest(q2 - q1, 200) END) AS h1,
         max(CASE WHEN k = 2 THEN q2 + 4 * greatest(q2 - q1, 1000) END) AS h2,
         max(CASE WHEN k = 3 THEN q2 + 4 * greatest(q2 - q1, 1000) END) AS h3,
         max(CASE WHEN k = 4 THEN q2 + 4 * greatest(q2 - q1, 75) END) AS h4,
         max(CASE WHEN k = 4 THEN q2 - 4 * greatest(q3 - q2, 75) END) AS l4
  FROM quart GROUP BY level, lang, source
), best AS (
  SELECT m.rid, row_number() OVER (PARTITION BY m.rid ORDER BY e.level) AS pick, e.h1, e.h2, e.h3, e.h4, e.l4
  FROM m JOIN fence e ON (e.level = 0 AND e.lang IS NOT DISTINCT FROM m.lang AND e.source IS NOT DISTINCT FROM m.source AND e.total >= 30)
                      OR (e.level = 1 AND e.lang IS NOT DISTINCT FROM m.lang AND e.total >= 30) OR e.level = 2
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(m1 <= h1 AND m2 <= h2 AND m3 <= h3 AND m4 <= h4 AND m4 >= l4, true) AS kept
FROM m LEFT JOIN best ON m.rid = best.rid AND pick = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filters": OP5, "op7_chat_formatting": OP7, "op10_quality_rules": OP10}
