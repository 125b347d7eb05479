"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import vec
from corpuscle.operators import filters as FL
from corpuscle.operators import search as S
from corpuscle.plans import testbed as TB
from corpuscle.plans.registry import query

_RANKED = f"""
scored AS (
  SELECT q.query_id, c.id, c.repo_id, c.parent_id, c.content, c.team,
         {TB.l2sq_sql('c.vector', 'q.qv')} AS distance
  FROM chunks_vec c, q WHERE {{where}}),
hits AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank
  FROM scored)"""


def _hits(where: str = "true") -> str:
    return f"WITH {TB.VECTORS_SQL}, {TB.QUERY_VECTORS_SQL}, {_RANKED.format(where=where)}"


_SCORE = "round(1 - distance, 9) AS score"


def _rounded(df):
    return df.withColumn("score", F.round("score", 9))


@query(
    "knn_topk",
    _hits("query_id = 0") + f" SELECT rank, id, {_SCORE} FROM hits WHERE rank <= 5",
)
def knn_topk(spark, sf):
    queries = TB.query_vectors(spark, sf).where("query_id = 0")
    return _rounded(S.similarity_search(TB.vectors(spark, sf), queries, 5).select("rank", "id", "score"))


@query(
    "knn_batch_topk",
    _hits() + f" SELECT query_id, rank, id, {_SCORE} FROM hits WHERE rank <= 15",
)
def knn_batch_topk(spark, sf):
    hits = S.similarity_search(TB.vectors(spark, sf), TB.query_vectors(spark, sf), 15)
    return _rounded(hits.select("query_id", "rank", "id", "score"))


@query(
    "knn_filtered",
    _hits("c.team = 'backend' AND c.repo_id = 'src3'")
    + f" SELECT query_id, rank, id, repo_id, team, {_SCORE} FROM hits WHERE rank <= 5",
)
def knn_filtered(spark, sf):
    where = FL.scope("src3", {"team": "backend"})
    hits = S.similarity_search(
        TB.vectors(spark, sf), TB.query_vectors(spark, sf), 5, where, payload=["repo_id", "team"]
    )
    return _rounded(hits.select("query_id", "rank", "id", "repo_id", "team", "score"))


@query(
    "knn_cosine",
    f"""WITH {TB.QUERY_VECTORS_SQL}, s AS (
      SELECT query_id, e.vec_id AS id, 1 - list_dot_product(e.embedding::DOUBLE[], qv::DOUBLE[])
        / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))
           * sqrt(list_dot_product(qv::DOUBLE[], qv::DOUBLE[]))) AS distance FROM embeddings e, q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, id, round(distance, 9) + 0.0 AS distance FROM r WHERE rank <= 5""",
)
def knn_cosine(spark, sf):
    corpus = TB.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    hits = S.similarity_search(corpus, TB.query_vectors(spark, sf), 5, metric="cosine")
    return hits.select("query_id", "rank", "id", (F.round("distance", 9) + 0.0).alias("distance"))


@query(
    "vector_metrics",
    f"""SELECT vec_id, round({TB.l2sq_sql('embedding', 'q0')}, 9) AS l2sq,
      round(list_dot_product(embedding::DOUBLE[], q0::DOUBLE[]), 9) AS inner_product,
      round(1 - list_dot_product(embedding::DOUBLE[], q0::DOUBLE[])
        / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))
           * sqrt(list_dot_product(q0::DOUBLE[], q0::DOUBLE[]))), 9) AS cosine
    FROM embeddings, (SELECT embedding AS q0 FROM embeddings WHERE vec_id = 0)""",
)
def vector_metrics(spark, sf):
    rows = TB.table(spark, sf, "embeddings")
    first = rows.where("vec_id = 0").select("embedding").scalar()
    with_target = rows.select("vec_id", "embedding", first.alias("q0"))
    a, b = F.col("embedding"), F.col("q0")
    return with_target.select(
        "vec_id",
        F.round(vec.require_distance(vec.l2sq(a, b)), 9).alias("l2sq"),
        F.round(vec.inner_product(a, b), 9).alias("inner_product"),
        F.round(vec.cosine(a, b), 9).alias("cosine"),
    )


_PARENT_SEARCH = f""",
cut AS (SELECT *, max(parent_id IS NOT NULL AND parent_id <> '') OVER (PARTITION BY query_id) AS any_parent
        FROM hits WHERE rank <= 15),
firsts AS (SELECT query_id, repo_id, parent_id, min(rank) AS r, arg_min(distance, rank) AS distance
           FROM cut WHERE parent_id IS NOT NULL AND parent_id <> '' GROUP BY ALL),
picked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank FROM firsts)
SELECT query_id, p.rank, d.id, d.repo_id, d.content, {_SCORE}, true AS is_parent
FROM picked p JOIN parents d ON d.repo_id = p.repo_id AND d.id = p.parent_id WHERE p.rank <= 5
UNION ALL
SELECT query_id, rank, CAST(id AS VARCHAR), repo_id, content, {_SCORE}, false
FROM cut WHERE NOT any_parent AND content IS NOT NULL AND content <> ''"""


@query(
    "parent_child_search",
    _hits().replace("WITH", f"WITH {TB.PARENTS_SQL},", 1) + _PARENT_SEARCH,
)
def parent_child_search(spark, sf):
    hits = S.parent_child(
        TB.vectors(spark, sf), TB.parents(spark, sf), TB.query_vectors(spark, sf), 5
    )
    return _rounded(hits)


@query(
    "parent_child_orphans",
    _hits("c.parent_id IS NULL").replace("WITH", f"WITH {TB.PARENTS_SQL},", 1) + _PARENT_SEARCH,
)
def parent_child_orphans(spark, sf):
    corpus = TB.vectors(spark, sf).where("parent_id IS NULL")
    return _rounded(S.parent_child(corpus, TB.parents(spark, sf), TB.query_vectors(spark, sf), 5))


_CONTENT = "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE content END"


@query(
    "chunk_search",
    _hits()
    + f""" SELECT query_id, rank, id, repo_id, {_CONTENT} AS content, {_SCORE} FROM hits
    WHERE rank <= 10 AND id % 4 > 1 AND content <> ''""",
)
def chunk_search(spark, sf):
    holes = TB.vectors(spark, sf).withColumn("content", F.expr(_CONTENT))
    return _rounded(S.search_chunks(holes, TB.query_vectors(spark, sf), 10)).select(
        "query_id", "rank", "id", "repo_id", "content", "score"
    )


_ASKED_META = "(query_id // 20) % 4"


@query(
    "search_with_meta",
    f"""WITH {TB.QUERY_VECTORS_SQL},
    l AS (SELECT doc_id, any_value(quality) AS quality, any_value(toxic) AS toxic FROM labels GROUP BY doc_id),
    c AS (SELECT vec_id AS id, embedding AS vector, quality, toxic, vec_id % 50 AS part FROM embeddings LEFT JOIN l ON doc_id = vec_id),
    s AS (SELECT query_id, id, quality, {TB.l2sq_sql('vector', 'qv')} AS distance FROM c, q WHERE CASE {_ASKED_META} WHEN 0 THEN true
      WHEN 1 THEN quality = 1 WHEN 2 THEN quality = 0 AND toxic = 0 ELSE part = query_id % 50 END),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, id, CAST(quality AS VARCHAR) AS quality, {_SCORE} FROM r WHERE rank <= 7""",
)
def search_with_meta(spark, sf):
    """Each query has conditions of its own: none, a label, two labels, or one of fifty parts; one pass over the corpus."""
    labels = TB.table(spark, sf, "labels").groupBy("doc_id").agg(F.any_value("quality").alias("quality"), F.any_value("toxic").alias("toxic"))
    text = lambda c: F.col(c).cast("string")
    entries = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(n).alias("key"), text(n).alias("value")) for n in ("quality", "toxic", "part")]), lambda e: e["value"].isNotNull()
    ))
    vectors = TB.table(spark, sf, "embeddings").join(labels, F.col("doc_id") == F.col("vec_id"), "left").withColumn("part", F.col("vec_id") % 50)
    corpus = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), entries.alias("meta"))
    kind, one, two = F.expr(_ASKED_META.replace("//", "div")), F.lit("quality"), F.lit("toxic")
    asked = (
        F.when(kind == 0, F.lit(None).cast("map<string,string>")).when(kind == 1, F.create_map(one, F.lit("1")))
        .when(kind == 2, F.create_map(one, F.lit("0"), two, F.lit("0"))).otherwise(F.create_map(F.lit("part"), (F.col("query_id") % 50).cast("string")))
    )
    hits = S.similarity_search(corpus, TB.query_vectors(spark, sf).withColumn("meta", asked), 7, payload=["meta"], meta="meta")
    return _rounded(hits.select("query_id", "rank", "id", F.col("meta")["quality"].alias("quality"), "score"))


@query(
    "min_score",
    _hits() + f" SELECT query_id, rank, id, {_SCORE} FROM hits WHERE rank <= 50 AND 1 - distance >= -0.5",
)
def min_score(spark, sf):
    hits = S.similarity_search(TB.vectors(spark, sf), TB.query_vectors(spark, sf), 50)
    return _rounded(FL.min_score(hits, -0.5).select("query_id", "rank", "id", "score"))


@query(
    "project_result",
    _hits()
    + f""" SELECT query_id, rank, id, repo_id, coalesce(nullif({_CONTENT}, ''), content, '') AS content,
    CAST(id AS VARCHAR) AS meta_id FROM hits WHERE rank <= 10""",
)
def project_result(spark, sf):
    corpus = TB.vectors(spark, sf).select(
        "id", "vector", "repo_id", F.expr(_CONTENT).alias("content"), F.create_map(F.lit("text"), "content").alias("metadata")
    )
    hits = S.similarity_search(
        corpus, TB.query_vectors(spark, sf), 10, payload=["repo_id", "content", "metadata"]
    )
    return S.project(hits).select(
        "query_id", "rank", "id", "repo_id", "content", F.col("metadata")["id"].alias("meta_id")
    )


_MEMORY = "concat('user', id % 3) = 'user1' AND label % 2 = 0"


@query(
    "memory_search",
    _hits(_MEMORY)
    + f""" SELECT query_id, rank, content, {_SCORE},
    epoch_ms(TIMESTAMP '2024-01-01 00:00:00') + id * 1000 AS timestamp FROM hits WHERE rank <= 5""",
)
def memory_search(spark, sf):
    memories = (
        TB.vectors(spark, sf)
        .withColumn("user_id", F.concat(F.lit("user"), F.col("id") % 3))
        .withColumn("type", F.when(F.col("label") % 2 == 0, "long_term_memory").otherwise("note"))
        .withColumn("timestamp", F.unix_millis(F.lit("2024-01-01").cast("timestamp")) + F.col("id") * 1000)
    )
    return _rounded(S.memory(memories, TB.query_vectors(spark, sf), "user1", "long_term_memory", 5))


@query(
    "normalize_k",
    """SELECT event_id, CAST(CASE WHEN k IS NULL OR k < 1 OR k <> floor(k) THEN 5 ELSE least(k, 100) END AS INTEGER) AS k
    FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN floor(value) * 3 - 2 ELSE value END AS k
          FROM events)""",
)
def normalize_k(spark, sf):
    k = F.expr("CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN floor(value) * 3 - 2 ELSE value END")
    return TB.table(spark, sf, "events").select("event_id", S.normalize_k(k).alias("k"))
