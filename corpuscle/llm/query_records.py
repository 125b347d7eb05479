from __future__ import annotations

from corpuscle.llm import repair, warc, witnesses
from corpuscle.llm.registry import query, table

# CRC-32 of ASCII text, bit by bit
CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

LEAF_SQL = """sha256(concat(
  coalesce(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
  coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-'),
  coalesce(concat(strlen({text}), ':', {text}), '-')))"""

# Languages are numbered under tree 0, their documents under trees 1 and up
OP13_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, {LEAF_SQL.format(text="text")} AS leaf,
         {LEAF_SQL.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other
  FROM documents),
r AS (
  SELECT doc_id, leaf, CASE WHEN crc % 3 = 0 THEN other ELSE leaf END AS folded, tree, spot, n FROM (
    SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY lang) AS n
    FROM l) JOIN (SELECT DISTINCT doc_id AS id, {CRC_SQL.format(text='doc_id::VARCHAR')} AS crc FROM documents) ON doc_id IS NOT DISTINCT FROM id),
up AS (
  SELECT tree, spot, n, leaf AS h, 0 AS lv FROM r
  UNION ALL
  SELECT tree, spot // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY spot)), any_value(lv) + 1 FROM up WHERE n > 1 GROUP BY tree, spot // 8),
sub AS (SELECT tree, h FROM up WHERE n = 1),
top AS (
  SELECT tree - 1 AS spot, (SELECT count(*) FROM sub) AS n, h, 0 AS lv FROM sub
  UNION ALL
  SELECT spot // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY spot)), any_value(lv) + 1 FROM top WHERE n > 1 GROUP BY spot // 8),
walk AS (
  SELECT doc_id, leaf, folded AS f, tree, spot, n, 0 AS lv, '' AS proof, tree AS t FROM r
  UNION ALL
  SELECT any_value(doc_id), leaf, sha256(string_agg(CASE WHEN up.spot = w.spot THEN f ELSE h END, '' ORDER BY up.spot)), w.tree, w.spot // 8, (w.n + 7) // 8, w.lv + 1,
         any_value(proof) || coalesce(string_agg(h, '' ORDER BY up.spot) FILTER (up.spot <> w.spot), ''), t
  FROM (SELECT *, row_number() OVER () AS one FROM walk WHERE n > 1) w JOIN up ON up.tree = w.tree AND up.lv = w.lv AND up.spot // 8 = w.spot // 8
  GROUP BY one, leaf, w.tree, w.spot, w.n, w.lv, t),
over AS (
  SELECT doc_id, leaf, f, tree - 1 AS spot, (SELECT count(*) FROM sub) AS n, 0 AS lv, proof, tree FROM walk WHERE n = 1
  UNION ALL
  SELECT any_value(doc_id), leaf, sha256(string_agg(CASE WHEN top.spot = w.spot THEN f ELSE h END, '' ORDER BY top.spot)), w.spot // 8, (w.n + 7) // 8, w.lv + 1,
         any_value(proof) || coalesce(string_agg(h, '' ORDER BY top.spot) FILTER (top.spot <> w.spot), ''), w.tree
  FROM (SELECT *, row_number() OVER () AS one FROM over WHERE n > 1) w JOIN top ON top.lv = w.lv AND top.spot // 8 = w.spot // 8
  GROUP BY one, leaf, w.tree, w.spot, w.n, w.lv)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = top.h AS verified
FROM over JOIN sub USING (tree), top WHERE over.n = 1 AND top.n = 1
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13_merkle_manifest(spark, sf_dir):
    return witnesses.verified(witnesses.manifest(table(spark, sf_dir, "documents")))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN strlen(payload) < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN strlen(payload) >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (payload)
"""


@query("op11_warc", OP11_SQL)
def op11_warc(spark, sf_dir):
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.pages_of(warc.read_archives(files, payload=False))


# q: 0 nothing yet, 1 after s, 2 after u, 3 after a; n rows may be inserted before an edit, and two at the end
OP12_SQL = rf"""
WITH RECURSIVE z AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC_SQL.format(text="concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM z, range(2) c(n) WHERE kind <> 0 AND n <= (kind = 3)::INT),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(concat(strlen(role), ':', role, text))) AS i FROM d),
f AS (
  SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    concat(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i), left(role, 1)) NOT IN ('su', 'ua', 'au') AND i > 1 AS bad FROM o),
w AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'audit': '', 'text': ''}} AS best FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, nq, min({{'cost': cost, 'audit': audit, 'text': out}}) FROM (
    SELECT f.conv_id, f.i, e.nq, best.cost + 3 * n + e.cost AS cost, concat(best.audit, repeat('I', n::INT), e.name) AS audit,
           concat(best.text, ins, CASE WHEN e.name = 'D' THEN '' ELSE concat(CASE WHEN best.text = '' AND n = 0 THEN '' ELSE chr(10) END, e.role, ':', text) END) AS out
    FROM (
      SELECT *, CASE n WHEN 0 THEN q ELSE CASE WHEN q = 2 THEN 3 ELSE 2 END + CASE WHEN n = 1 THEN 0 WHEN q = 2 THEN -1 ELSE 1 END END AS p,
             concat(CASE WHEN n > 0 THEN concat(CASE WHEN best.text = '' THEN '' ELSE chr(10) END, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END) ELSE '' END,
                    CASE WHEN n > 1 THEN concat(chr(10), CASE WHEN q = 2 THEN 'user:' ELSE 'assistant:' END) ELSE '' END) AS ins
      FROM w, range(3) r(n)) w
    JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1, LATERAL (
      SELECT 'D' AS name, 4 AS cost, p AS nq, '' AS role
      UNION ALL SELECT 'R', 3 + 3 * (fault IS NOT NULL)::INT, CASE WHEN p = 2 THEN 3 ELSE 2 END, CASE WHEN p = 2 THEN 'assistant' ELSE 'user' END WHERE fault IS NULL OR fault = 'truncated'
      UNION ALL SELECT 'K', 3 * (fault IS NOT NULL)::INT, CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, f.role
        WHERE (fault IS NULL OR fault = 'truncated') AND ((c = 's' AND p = 0) OR (c = 'u' AND p <> 2) OR (c = 'a' AND p = 2))) e)
  GROUP BY conv_id, i, nq),
x AS (
  SELECT conv_id, min({{'cost': best.cost + 3 * n, 'audit': concat(best.audit, repeat('I', n)),
    'text': concat(best.text, CASE q WHEN 1 THEN concat(chr(10), 'user:', chr(10), 'assistant:') WHEN 2 THEN concat(chr(10), 'assistant:') ELSE '' END)}}) AS best
  FROM (SELECT *, CASE q WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n FROM w)
  WHERE (conv_id, i) IN (SELECT (conv_id, max(i)) FROM f GROUP BY conv_id) GROUP BY conv_id),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
         count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(bad) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(best.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query("op12_conversation_repair", OP12_SQL)
def op12_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return repair.repaired(rows, repair.damaged(rows))
