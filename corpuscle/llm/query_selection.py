from __future__ import annotations

from corpuscle.llm import containment, mixing, reputation
from corpuscle.llm.registry import query, table

SHINGLES_SQL = r"""
  SELECT {key} AS k, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh
  FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM {table})
  WHERE len(ws) > 0"""

OP5_SQL = f"""
WITH d AS (SELECT DISTINCT * FROM ({SHINGLES_SQL.format(key="doc_id", table="documents")})),
b AS (SELECT DISTINCT * FROM ({SHINGLES_SQL.format(key="item_id", table="benchmark")})),
n AS (SELECT k, count(*) AS n FROM b GROUP BY k)
SELECT d.k AS doc_id, b.k AS item_id, count(*) AS shared, count(*) / any_value(n.n) AS containment
FROM d JOIN b ON d.sh = b.sh JOIN n ON n.k = b.k GROUP BY 1, 2 HAVING count(*) * 100 >= any_value(n.n) * 75
"""

OP6_SQL = r"""
WITH z AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('mix', doc_id)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
o AS (
  SELECT source, source_size, 2 * source_size AS room,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
f AS (
  SELECT *, row_number() OVER w AS nth,
         (1.5 * (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - (sum(room) OVER w - room))
           / CAST(sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM o WINDOW w AS (ORDER BY room / weight, source NULLS LAST)),
g AS (SELECT min(nth) AS first, min_by(level, nth) AS fill FROM f WHERE level <= room / weight),
t AS (
  SELECT source, source_size, CASE WHEN nth < coalesce(first, 2147483647) THEN CAST(room AS DOUBLE) ELSE fill * weight END AS target FROM f, g),
r AS (
  SELECT z.doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         CAST(sum(size) OVER (PARTITION BY z.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS ahead
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
         + greatest(0, least(size, budget % source_size - ahead)) END AS BIGINT) AS taken
FROM r
"""

OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM u),
l AS (SELECT doc_id, count(*) AS n, sum(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT *, CASE WHEN len(parts) <= 2 OR regexp_matches(host, '^[0-9.]+$') THEN host
    WHEN length(parts[-1]) = 2 AND parts[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN array_to_string(parts[-3:], '.')
    ELSE array_to_string(parts[-2:], '.') END AS domain
  FROM (SELECT host, string_split(host, '.') AS parts, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS good
        FROM p LEFT JOIN l ON l.doc_id = p.page_id GROUP BY host)),
h2 AS (SELECT *, CASE WHEN contains(domain, '.') THEN regexp_extract(domain, '[^.]*$') ELSE '' END AS suffix FROM h),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h2 GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (sum(sum(good)) OVER () + 1) / (sum(sum(n)) OVER () + 2) AS p FROM d GROUP BY suffix),
ms AS (SELECT greatest(0.001, least(0.5, coalesce((sum((good - n * p) ** 2 / (p * (1 - p))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0.001))) AS v FROM s),
ps AS (SELECT suffix, (good + (1 - v) / v * p) / (n + (1 - v) / v) AS p FROM s, ms),
dp AS (SELECT d.*, ps.p FROM d JOIN ps USING (suffix)),
md AS (SELECT greatest(0.001, least(0.5, coalesce((sum((good - n * p) ** 2 / (p * (1 - p))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0.001))) AS v FROM dp),
pd AS (SELECT domain, (good + (1 - v) / v * p) / (n + (1 - v) / v) AS p FROM dp, md),
hp AS (SELECT host, n, good, pd.p FROM h2 JOIN pd USING (domain)),
mh AS (SELECT greatest(0.001, least(0.5, coalesce((sum((good - n * p) ** 2 / (p * (1 - p))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0.001))) AS v FROM hp),
ph AS (SELECT host, (good + (1 - v) / v * p) / (n + (1 - v) / v) AS mean, n + (1 - v) / v AS size FROM hp, mh),
b AS (SELECT host, mean + 1.645 * sqrt(mean * (1 - mean) / (size + 1)) AS upper FROM ph),
r AS (
  SELECT p.*, upper, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p JOIN b USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


@query("op5_benchmark_decontamination", OP5_SQL)
def op5_benchmark_decontamination(spark, sf_dir):
    return containment.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


@query("op6_source_mixing", OP6_SQL)
def op6_source_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("row", "src")


@query("op7_url_reputation", OP7_SQL)
def op7_url_reputation(spark, sf_dir):
    return reputation.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
