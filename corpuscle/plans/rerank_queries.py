"""Queries of second passes over search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import keyword as K
from corpuscle.operators import rerank as RR
from corpuscle.operators import search as S
from corpuscle.operators.chunking import prose
from corpuscle.plans import testbed as TB
from corpuscle.plans.ledger_queries import _BM25
from corpuscle.plans.registry import query
from corpuscle.plans.scalar_queries import words_sql
from corpuscle.plans.search_queries import _RANKED
from corpuscle.plans.store_queries import _PARAGRAPHS_SQL

_FOUND = f"{TB.VECTORS_SQL}, {TB.QUERY_VECTORS_SQL}, {_RANKED.format(where='true')}"


@query(
    "diverse_search",
    f"""WITH RECURSIVE {_FOUND},
    cand AS MATERIALIZED (SELECT query_id, id, rank, 1 - distance AS score, c.vector FROM hits JOIN chunks_vec c USING (id) WHERE rank <= 12),
    alike AS MATERIALIZED (SELECT a.query_id, a.id AS a, b.id AS b, 1 - {TB.l2sq_sql('a.vector', 'b.vector')} AS s
                           FROM cand a JOIN cand b USING (query_id)),
    chosen(query_id, nth, ids) AS (
      SELECT query_id, 1, [id] FROM cand WHERE rank = 1
      UNION ALL
      SELECT query_id, nth + 1, list_append(ids, first(id ORDER BY worth DESC, rank)) FROM (
        SELECT g.query_id, g.nth, g.ids, c.id, c.rank, round(0.7 * c.score - 0.3 * max(n.s), 9) AS worth
        FROM chosen g JOIN cand c ON c.query_id = g.query_id AND NOT list_contains(g.ids, c.id)
        JOIN alike n ON n.query_id = c.query_id AND n.a = c.id AND list_contains(g.ids, n.b)
        WHERE g.nth < 5 GROUP BY g.query_id, g.nth, g.ids, c.id, c.rank, c.score)
      GROUP BY query_id, nth, ids)
    SELECT g.query_id, CAST(nth AS INTEGER) AS rank, c.rank AS found_rank, c.id, round(c.score, 9) AS score
    FROM chosen g JOIN cand c ON c.query_id = g.query_id AND c.id = g.ids[g.nth]""",
)
def diverse_search(spark, sf):
    hits = S.similarity_search(TB.vectors(spark, sf), TB.query_vectors(spark, sf), 12, payload=["vector"])
    return RR.diversified(hits, 5, 0.7).select("query_id", "rank", "found_rank", "id", F.round("score", 9).alias("score"))


@query(
    "second_hop",
    f"""WITH {_FOUND},
    start AS (SELECT query_id, id AS via, distance AS so_far FROM hits WHERE rank <= 3),
    seeds AS (SELECT id AS via, vector AS sv FROM chunks_vec WHERE id IN (SELECT via FROM start)),
    reach AS (SELECT via, c.id, {TB.l2sq_sql('c.vector', 'sv')} AS distance FROM chunks_vec c, seeds),
    near AS (SELECT * FROM reach QUALIFY row_number() OVER (PARTITION BY via ORDER BY distance, id) <= 10),
    ways AS (SELECT query_id, id, 1 AS hops, NULL::BIGINT AS via, round(distance, 9) AS distance FROM hits WHERE rank <= 10
             UNION ALL
             SELECT query_id, id, 2, via, round(so_far + distance, 9) FROM start JOIN near USING (via)),
    best AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY distance, hops, via) = 1),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM best)
    SELECT query_id, rank, id, hops, via, round(distance, 6) AS distance FROM r WHERE rank <= 10""",
)
def second_hop(spark, sf):
    found = RR.second_hop(TB.vectors(spark, sf), TB.query_vectors(spark, sf), 10)
    return found.withColumn("distance", F.round("distance", 6))


@query(
    "compressed_hits",
    f"""WITH {_PARAGRAPHS_SQL}, {_BM25},
    found AS (SELECT query_id, position, id, regexp_extract_all(content, '[^.!?]+[.!?]*') AS p FROM best JOIN chunks USING (id) WHERE position <= 5),
    parts AS (SELECT query_id, position, id, unnest(p) AS part, unnest(range(len(p))) AS nth FROM found),
    asked AS (SELECT item_id AS query_id, {words_sql('text')} AS words FROM benchmark),
    rated AS (SELECT parts.*, len(list_intersect(list_distinct({words_sql('part')}), words)) AS shared FROM parts JOIN asked USING (query_id)),
    top AS (SELECT * FROM rated WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY shared DESC, nth) <= 2)
    SELECT query_id, position, id, string_agg(trim(part), ' ' ORDER BY nth) AS content FROM top GROUP BY query_id, position, id""",
)
def compressed_hits(spark, sf):
    chunks = prose.paragraphs(TB.parents(spark, sf, wide=True))
    queries = TB.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = K.keyword_search(chunks, queries, 5, payload=["content"])
    return RR.compressed(hits, queries, 2).select("query_id", "position", "id", "content")
