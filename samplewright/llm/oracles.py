"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][(r % 3 + 1)::INT]::DOUBLE AS weight, 3.0 * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
f AS (
  SELECT (SELECT rate FROM l WHERE rate * weight <= cap ORDER BY cap / weight, r LIMIT 1) AS rate),
t AS (
  SELECT l.source, l.source_size, l.r, least(cap, coalesce(f.rate * weight, cap))::DOUBLE AS target FROM l, f),
p AS (
  SELECT d.*, t.source_size, t.target, t.r, floor(t.target)::BIGINT AS goal,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (
  SELECT *, CASE WHEN target > 0 THEN least(1.0::DOUBLE, start::DOUBLE / target) ELSE 0.0::DOUBLE END AS u FROM p)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * size
        + least(size, greatest(0, goal - CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * source_size - start)))::BIGINT AS taken,
       -- the time at which the integral of the source's weight schedule reaches u: fading out from 1.5 to 0.5, or in from 0.5 to 1.5
       CASE WHEN start >= goal THEN NULL
            WHEN r % 3 = 0 AND u < 0.625 THEN 1.5::DOUBLE - sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2.0::DOUBLE * u))
            WHEN r % 3 = 0 THEN 0.5::DOUBLE + (1.0::DOUBLE - sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE * (u - 0.625::DOUBLE))))
            WHEN u < 0.375 THEN sqrt(0.25::DOUBLE + 2.0::DOUBLE * u) - 0.5::DOUBLE
            ELSE 0.5::DOUBLE + (sqrt(1.0::DOUBLE + 2.0::DOUBLE * (u - 0.375::DOUBLE)) - 1.0::DOUBLE) END AS position
FROM y
"""

_RULE = r"""CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END"""
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPLIT = f"translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path"

#: Rules, then blocks of aliases by the closure of canonical links and meta refreshes. Dot segments, base elements and
#: character references in targets are left to the operator's own tests.
OP5 = rf"""
WITH RECURSIVE pg AS (
  SELECT url, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g') AS html,
         regexp_extract(url, '(?s)^(.*?:)//', 1) AS scheme, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS origin,
         regexp_extract(url, '(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)', 1) AS folder
  FROM pages WHERE contains(url, '://')),
tags AS (
  SELECT pg.*, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pg),
targets AS (
  SELECT *, CASE WHEN regexp_matches(tag, '(?i)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?\s*([^"''>\s]+)', 1)
                 WHEN regexp_matches(tag, '(?i)^<meta\b.*http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?\s*([^"''>\s]+)', 1) END AS t FROM tags),
links AS (
  SELECT url AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || t WHEN starts_with(t, '/') THEN origin || t
                        WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(t, '?') THEN regexp_extract(url, '(?s)^([^?#]*)', 1) || t
                        ELSE origin || CASE WHEN folder = '' THEN '/' ELSE folder END || t END AS b
  FROM targets WHERE t <> ''),
ids AS (
  SELECT DISTINCT translate(regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1), {_AZ}) || regexp_extract(a, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS a,
                  translate(regexp_extract(b, '(?s)^(.*?://[^/?#]*)', 1), {_AZ}) || regexp_extract(b, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b FROM links WHERE b IS NOT NULL),
edges AS (SELECT a, b FROM ids UNION SELECT b, a FROM ids),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
ends AS (SELECT a, substr(b, strpos(b, '://') + 3) AS rest FROM reach),
ruled AS (SELECT a, {_RULE} AS rule FROM (SELECT a, {_SPLIT} FROM ends)),
blocked AS (SELECT DISTINCT a FROM ruled WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/')),
u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, {_SPLIT} FROM u),
r AS (SELECT *, {_RULE} AS rule FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN contains(url, '://') AND translate(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), {_AZ}) || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) IN (SELECT a FROM blocked) THEN 'block'
            ELSE 'allow' END AS verdict
FROM r
"""

OP10 = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (w ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256({_LOWER}) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY {_LOWER})
"""

ORACLES = {"op3_mixing": OP3, "op5_url_filter": OP5, "op10_exact_dedup": OP10}
