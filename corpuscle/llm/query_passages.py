from __future__ import annotations

from corpuscle.llm import recompression, suffix_arrays
from corpuscle.llm.registry import query, table

OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, s, hash(array_to_string(ws[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (
  SELECT doc_id, list(s) AS starts FROM win JOIN first USING (h) WHERE m < doc_id GROUP BY doc_id),
cover AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM gone))
  GROUP BY doc_id),
keep AS (
  SELECT k.doc_id, string_agg(ws[k.p], ' ' ORDER BY k.p) AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE doc_id IN (SELECT doc_id FROM cover)) k
  LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM cover) c ON c.doc_id = k.doc_id AND c.p = k.p
  WHERE c.p IS NULL GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN keep USING (doc_id)
"""


@query("op4_substring_dedup", OP4_SQL)
def op4_substring_dedup(spark, sf_dir):
    return recompression.remove_repeats(table(spark, sf_dir, "documents"))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    return suffix_arrays.remove_repeats(table(spark, sf_dir, "documents"))
