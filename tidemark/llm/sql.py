"""DuckDB SQL of the queries that SQL can express."""

from .url_reputation import SUFFIXES

#: Rules in order of length, so that the last that fits is the longest.
OP7_SQL = f"""
WITH u AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0
              THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(split_part(coalesce(rest, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(coalesce(rest, ''), length(split_part(coalesce(rest, ''), '/', 1)) + 1) AS path
  FROM u),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
outcome AS (
  SELECT page_id, max(bad) AS bad FROM p JOIN marks ON try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') AS BIGINT) = doc_id
  GROUP BY page_id),
h0 AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, regexp_replace(host, ':[0-9]*$', '') AS bare
  FROM p LEFT JOIN outcome USING (page_id) GROUP BY host),
h AS (
  SELECT host, n, k,
         CASE WHEN address THEN bare WHEN two IN {SUFFIXES} THEN two ELSE labels[-1] END AS suffix,
         CASE WHEN address THEN bare WHEN two IN {SUFFIXES} AND len(labels) > 2 THEN labels[-3] || '.' || two ELSE two END AS domain
  FROM (SELECT *, string_split(bare, '.') AS labels, regexp_full_match(bare, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AS address,
               CASE WHEN len(string_split(bare, '.')) < 2 THEN bare
                    ELSE string_split(bare, '.')[-2] || '.' || string_split(bare, '.')[-1] END AS two
        FROM h0)),
total AS (SELECT (sum(k) + 1)::DOUBLE / (sum(n) + 2) AS mean FROM h),
s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, (SELECT mean FROM total) AS m FROM h GROUP BY suffix),
s_str AS (
  SELECT 1 / least(greatest(coalesce(sum(pow(k - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.5) - 1 AS g FROM s0),
s AS (SELECT suffix, (k + (SELECT g FROM s_str) * m) / (n + (SELECT g FROM s_str)) AS m FROM s0),
d0 AS (SELECT h.suffix, domain, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, any_value(s.m) AS m FROM h JOIN s USING (suffix) GROUP BY h.suffix, domain),
d_str AS (
  SELECT 1 / least(greatest(coalesce(sum(pow(k - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.5) - 1 AS g FROM d0),
d AS (SELECT suffix, domain, (k + (SELECT g FROM d_str) * m) / (n + (SELECT g FROM d_str)) AS m FROM d0),
e AS (SELECT host, n::DOUBLE AS n, k::DOUBLE AS k, d.m FROM h JOIN d USING (suffix, domain)),
e_str AS (
  SELECT 1 / least(greatest(coalesce(sum(pow(k - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.001), 0.001), 0.5) - 1 AS g FROM e),
r AS (
  SELECT host, (k + g * m) / (n + g) AS rate, n + g AS weight FROM e, e_str),
b AS (SELECT host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) AS bound FROM r),
j AS (
  SELECT page_id, host, path, rate, bound,
         CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
              WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM p JOIN b USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(rate, 6) AS bad_rate, round(bound, 6) AS bad_bound
FROM j
"""
