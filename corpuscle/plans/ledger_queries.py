"""Job ledger, sessions, keyword and prompt search."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import chat
from corpuscle.operators import embed as E
from corpuscle.operators import jobs as J
from corpuscle.operators import keyword as K
from corpuscle.operators import postings as PO
from corpuscle.operators import search as S
from corpuscle.operators import sessions as SE
from corpuscle.operators.chunking import prose
from corpuscle.plans import retrieval as R
from corpuscle.plans import testbed as TB
from corpuscle.plans.registry import query
from corpuscle.plans.scalar_queries import bucket_sql, words_sql
from corpuscle.plans.store_queries import _PARAGRAPHS_SQL
from corpuscle.session import scratch_path

_LATEST = f"""{TB.JOB_EVENTS_SQL},
latest AS (
  SELECT job_id, arg_max(state, (ts, event_id)) AS state, arg_max_null(reason, (ts, event_id)) AS reason, min(ts) AS queued_at,
         max(ts) FILTER (WHERE state = 'active') AS processed_on, max(ts) AS changed_at,
         count(*) FILTER (WHERE state = 'failed') AS attempts
  FROM job_events GROUP BY job_id)"""


@query(
    "job_status",
    f"""WITH {_LATEST} SELECT 'job-' || n AS job_id, state, CASE WHEN state IS NULL THEN NULL WHEN state = 'completed' THEN 100 ELSE 0 END::INTEGER AS progress,
    state IS NOT NULL AS found FROM (SELECT DISTINCT user_id + 1 AS n FROM events) LEFT JOIN latest ON job_id = 'job-' || n""",
)
def job_status(spark, sf):
    wanted = TB.table(spark, sf, "events").select(F.concat(F.lit("job-"), F.col("user_id") + 1).alias("job_id")).distinct()
    return J.lookup(wanted, TB.job_events(spark, sf))


@query(
    "failed_jobs",
    f"""WITH {_LATEST} SELECT 'repository' AS queue_type, job_id, coalesce(reason, 'Unknown error') AS failed_reason, attempts,
    changed_at AS failed_at, count(*) OVER () AS total_failed FROM latest WHERE state = 'failed'""",
)
def failed_jobs(spark, sf):
    return J.failed(TB.job_events(spark, sf))


@query(
    "failed_details",
    f"""WITH {_LATEST}, r AS (SELECT job_id, coalesce(reason, 'Unknown error') AS reason,
      row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS nth FROM job_events WHERE state = 'failed'),
    s AS (SELECT job_id, string_agg(reason, chr(10) ORDER BY nth) AS stacktrace FROM r GROUP BY job_id)
    SELECT job_id, coalesce(reason, 'Unknown error') AS failed_reason, stacktrace, attempts, queued_at, processed_on, changed_at AS finished_on
    FROM latest JOIN s USING (job_id) WHERE state = 'failed'""",
)
def failed_details(spark, sf):
    return J.failed_details(TB.job_events(spark, sf))


@query(
    "retry_all",
    f"""WITH {_LATEST} SELECT job_id, TIMESTAMP '2024-02-01 00:00:00' AS ts, 'queued' AS state FROM latest WHERE state = 'failed'""",
)
def retry_all(spark, sf):
    return J.retry(TB.job_events(spark, sf), None, F.lit("2024-02-01").cast("timestamp_ntz"))


@query(
    "retry_outcome",
    f"""WITH {_LATEST} SELECT 'job-' || n AS job_id, CASE WHEN state IS NULL THEN 'not found' WHEN state = 'failed' THEN 'requeued'
      ELSE concat('not failed: ', state) END AS outcome
    FROM (SELECT DISTINCT user_id * 2 AS n FROM events) LEFT JOIN latest ON job_id = 'job-' || n""",
)
def retry_outcome(spark, sf):
    wanted = TB.table(spark, sf, "events").select(F.concat(F.lit("job-"), F.col("user_id") * 2).alias("job_id")).distinct()
    return J.retry_outcome(TB.job_events(spark, sf), wanted)


_SMALL_JOBS = _LATEST.replace("concat('job-', user_id)", "concat('job-', event_id // 3)")


def _small_jobs(spark, sf):
    return TB.job_events(spark, sf).withColumn("job_id", F.concat(F.lit("job-"), F.floor(F.col("event_id") / 3)))


@query(
    "retry_schedule",
    f"""WITH {_SMALL_JOBS}
    SELECT job_id, attempts, CASE WHEN attempts < 3 THEN changed_at + to_seconds(5 * pow(2, attempts - 1)) END AS next_attempt
    FROM latest WHERE state = 'failed'""",
)
def retry_schedule(spark, sf):
    return J.retry_schedule(_small_jobs(spark, sf))


@query(
    "job_retention",
    f"""WITH {_SMALL_JOBS}, now AS (SELECT max(ts) - INTERVAL 30 MINUTE AS cut_at FROM events),
    c AS (SELECT * FROM latest WHERE state = 'completed' ORDER BY changed_at DESC, job_id LIMIT 100)
    SELECT job_id, state, changed_at FROM c, now WHERE changed_at >= cut_at - INTERVAL 1 HOUR
    UNION ALL SELECT job_id, state, changed_at FROM latest, now WHERE state = 'failed' AND changed_at >= cut_at - INTERVAL 24 HOUR""",
)
def job_retention(spark, sf):
    events = _small_jobs(spark, sf)
    now = events.agg(F.max("ts") - F.expr("INTERVAL 30 MINUTES")).scalar()
    return J.retained(events, now)


_MESSAGES_SQL = """
messages AS (
  SELECT conv_id AS session_id, turn, role, text, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 10 + turn * 3 AS BIGINT)) AS ts
  FROM conversations)"""


def _messages(spark, sf):
    seconds = F.lit(1704067200) + (F.col("conv_id") * 10 + F.col("turn") * 3) * 60
    return TB.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", "text", F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("ts")
    )


@query(
    "session_summary",
    f"""WITH {_MESSAGES_SQL} SELECT session_id, min(ts) AS created_at, max(ts) AS last_accessed_at, count(*) AS message_count
    FROM messages GROUP BY ALL""",
)
def session_summary(spark, sf):
    return SE.summary(_messages(spark, sf))


@query(
    "context_window",
    f"""WITH {_MESSAGES_SQL} SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 3""",
)
def context_window(spark, sf):
    return SE.context_window(_messages(spark, sf), 3)


@query(
    "session_windows",
    """WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS opened
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM o)
    SELECT user_id, min(ts) AS created_at, max(ts) AS last_accessed_at, CAST(count(*) AS BIGINT) AS message_count FROM n GROUP BY user_id, nr""",
)
def session_windows(spark, sf):
    return SE.sessionize(TB.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_accessed_at")}
    )


_BM25 = f"""
tokens AS (SELECT id, repo_id, {words_sql('content')} AS words FROM chunks),
stats AS (SELECT count(*) AS n, avg(len(words)) AS average FROM tokens),
tf AS (SELECT id, repo_id, len(words) AS dl, w, count(*) AS tf FROM (SELECT id, repo_id, words, unnest(words) AS w FROM tokens) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
qw AS (SELECT DISTINCT item_id AS query_id, unnest({words_sql('text')}) AS w FROM benchmark),
scored AS (
  SELECT query_id, id, repo_id,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))), 6) AS rank
  FROM qw JOIN tf USING (w) JOIN df USING (w), stats GROUP BY ALL),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id) AS INTEGER) AS position FROM scored)"""


@query(
    "keyword_bm25",
    f"WITH {_PARAGRAPHS_SQL}, {_BM25} SELECT query_id, position, id, repo_id, rank FROM best WHERE position <= 10 AND rank >= 8",
)
def keyword_bm25(spark, sf):
    chunks = prose.paragraphs(TB.parents(spark, sf, wide=True))
    queries = TB.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return K.keyword_search(chunks, queries, 10, 8.0, payload=["repo_id"])


def _index(spark, sf):
    index = PO.Index(spark, scratch_path(spark, "postings"), 16)
    index.build(prose.paragraphs(TB.parents(spark, sf, wide=True)))
    return index


@query(
    "keyword_indexed",
    f"WITH {_PARAGRAPHS_SQL}, {_BM25} SELECT query_id, position, id, repo_id, rank FROM best WHERE position <= 10",
)
def keyword_indexed(spark, sf):
    """Every benchmark item on stored postings."""
    queries = TB.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _index(spark, sf).search(queries, 10)


@query(
    "keyword_by_repository",
    f"""WITH {_PARAGRAPHS_SQL}, {_BM25.replace("ORDER BY rank DESC, id) AS INTEGER) AS position FROM scored)", "ORDER BY rank DESC, id) AS INTEGER) AS position FROM scored WHERE query_id % 3 = 0 OR repo_id = concat('src', query_id % 20))")}
    SELECT query_id, position, id, repo_id, rank FROM best WHERE position <= 5 AND rank >= 6""",
)
def keyword_by_repository(spark, sf):
    """Items ask one repository each, every third one all of them."""
    item = F.col("item_id")
    repo = F.when(item % 3 != 0, F.concat(F.lit("src"), (item % 20).cast("string")))
    queries = TB.table(spark, sf, "benchmark").select(item.alias("query_id"), "text", repo.alias("repo_id"))
    return _index(spark, sf).search(queries, 5, 6.0)


_SEMANTIC = f"""
b AS (SELECT id, repo_id, content, {bucket_sql(words_sql('content'))} AS b FROM chunks),
bc AS (SELECT id, bucket, count(*) AS c FROM (SELECT id, unnest(b) AS bucket FROM b) GROUP BY ALL),
bv AS (SELECT id, bucket, CAST(CAST(c / sqrt(CAST(sum(c * c) OVER (PARTITION BY id) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS v FROM bc),
dense AS (SELECT d.id, list(coalesce(v, 0) ORDER BY i) AS vec FROM (SELECT DISTINCT id FROM bv) d CROSS JOIN range(64) r(i)
          LEFT JOIN bv ON bv.id = d.id AND bucket = i GROUP BY d.id),
qb AS (SELECT item_id AS query_id, concat('src', item_id % 20) AS qrepo, {bucket_sql(words_sql('text'))} AS b FROM benchmark),
qc AS (SELECT query_id, qrepo, i, CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE) AS c FROM qb, range(64) r(i)),
qv AS (SELECT query_id, qrepo, i, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS FLOAT) AS DOUBLE) AS v FROM qc),
qd AS (SELECT query_id, qrepo, list(v ORDER BY i) AS vec FROM qv GROUP BY ALL),
dist AS (SELECT query_id, id, b.repo_id, b.content, {TB.l2sq_sql('dense.vec', 'qd.vec')} AS distance
         FROM qd JOIN b ON b.repo_id = qrepo JOIN dense USING (id)),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM dist)"""


def _requests(spark, sf):
    return TB.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("repo_id"), F.col("text").alias("prompt"),
        F.lit(None).cast("double").alias("k"),
    )


def _embedded(spark, sf):
    chunks = prose.paragraphs(TB.parents(spark, sf, wide=True))
    return E.embed(chunks.withColumn("parent_id", F.col("file_path")))


@query(
    "semantic_chunk_search",
    f"WITH {_PARAGRAPHS_SQL}, {_SEMANTIC} SELECT query_id, rank, id, repo_id, content, round(1 - distance, 6) AS score FROM hits WHERE rank <= 5",
)
def semantic_chunk_search(spark, sf):
    hits = R.search_chunks(_requests(spark, sf), _embedded(spark, sf))
    return hits.select("query_id", "rank", "id", "repo_id", "content", F.round("score", 6).alias("score"))


@query(
    "semantic_search",
    f"""WITH {_PARAGRAPHS_SQL}, {_SEMANTIC},
    firsts AS (SELECT query_id, repo_id, split_part(id, ':', 1) AS id, min(rank) AS r, arg_min(distance, rank) AS distance FROM hits WHERE rank <= 15 GROUP BY ALL),
    picked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank FROM firsts)
    SELECT query_id, p.rank, p.id, p.repo_id, d.text AS content, round(1 - distance, 6) AS score, true AS is_parent
    FROM picked p JOIN documents d ON p.id = concat(d.source, '/', d.doc_id, '.md') WHERE p.rank <= 5""",
)
def semantic_search(spark, sf):
    hits = R.search(_requests(spark, sf), _embedded(spark, sf), TB.parents(spark, sf))
    return hits.withColumn("score", F.round("score", 6))


@query(
    "hybrid_search",
    f"""WITH {_PARAGRAPHS_SQL}, {_BM25}, {_SEMANTIC},
    votes AS (SELECT query_id, id, position AS rank FROM best WHERE position <= 10 UNION ALL SELECT query_id, id, rank FROM hits WHERE rank <= 5),
    fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused_score FROM votes GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, id) AS INTEGER) AS rank FROM fused)
    SELECT query_id, id, fused_score, rank FROM r WHERE rank <= 5""",
)
def hybrid_search(spark, sf):
    near = R.search_chunks(_requests(spark, sf), _embedded(spark, sf))
    chunks = prose.paragraphs(TB.parents(spark, sf, wide=True))
    queries = TB.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    words = K.keyword_search(chunks, queries, 10).drop("rank").withColumnRenamed("position", "rank")
    return S.reciprocal_rank_fusion([words, near], 5)


@query(
    "context_pack",
    f"""WITH {_PARAGRAPHS_SQL}, {_SEMANTIC} SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context
    FROM hits WHERE rank <= 5 GROUP BY query_id""",
)
def context_pack(spark, sf):
    return chat.context_pack(R.search_chunks(_requests(spark, sf), _embedded(spark, sf)))
