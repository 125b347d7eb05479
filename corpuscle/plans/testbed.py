"""How the driver's tables stand in for corpus tables.

Every function has its SQL text beside it, from which the oracles are built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.session import widen


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is bound by the processor."""
    return widen(table(spark, sf_dir, name))


def swapped(text: Column, letters: str, by: str) -> Column:
    """The text with ``by`` for each of some letters. A translation would make a string of every character."""
    for letter in letters:
        text = F.replace(text, F.lit(letter), F.lit(by))
    return text


PARENTS_SQL = """
parents AS (
  SELECT concat(source, '/', doc_id, '.md') AS id, source AS repo_id, text AS content, lang, doc_id
  FROM documents)"""


def parents(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    docs = wide_table(spark, sf_dir, "documents") if wide else table(spark, sf_dir, "documents")
    return docs.select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("id"),
        F.col("source").alias("repo_id"),
        F.col("text").alias("content"),
        "lang",
        "doc_id",
    )


VECTORS_SQL = """
chunks_vec AS (
  SELECT e.vec_id AS id, e.embedding AS vector, e.label,
         d.source AS repo_id,
         CASE WHEN e.label < 5 THEN 'backend' ELSE 'frontend' END AS team,
         CASE WHEN e.vec_id % 50 <> 0 THEN concat(d.source, '/', d.doc_id, '.md') END AS parent_id,
         d.text AS content
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id // 3)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector records; three chunks in a row belong to one document, every fiftieth has no parent."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    vecs = table(spark, sf_dir, "embeddings").withColumn("doc_id", F.floor(F.col("vec_id") / 3))
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".md"))
    return vecs.join(docs, "doc_id").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vector"),
        "label",
        F.col("source").alias("repo_id"),
        F.when(F.col("label") < 5, "backend").otherwise("frontend").alias("team"),
        F.when(F.col("vec_id") % 50 != 0, path).alias("parent_id"),
        F.col("text").alias("content"),
    )


QUERY_VECTORS_SQL = """
q AS (SELECT CAST(vec_id AS BIGINT) AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0)"""


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector is asked of all."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return rows.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))


def l2sq_sql(a: str, b: str) -> str:
    return (
        f"list_reduce(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), "
        "lambda z: (z[1]-z[2])*(z[1]-z[2])), lambda x, y: x + y)"
    )


SNAPSHOTS_SQL = """
snap_a AS (
  SELECT source AS repo_id, concat(source, '/', doc_id, '.md') AS path, text AS content
  FROM documents WHERE doc_id % 10 <> 0),
snap_b AS (
  SELECT source AS repo_id,
         CASE WHEN doc_id % 13 = 0 THEN concat(source, '/', doc_id, '.md.moved')
              ELSE concat(source, '/', doc_id, '.md') END AS path,
         CASE WHEN doc_id % 11 = 0 THEN concat(text, ' changed') ELSE text END AS content
  FROM documents WHERE doc_id % 7 <> 3)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = wide_table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".md"))
    before = docs.where("doc_id % 10 <> 0").select(
        F.col("source").alias("repo_id"), path.alias("path"), F.col("text").alias("content")
    )
    moved = F.when(F.col("doc_id") % 13 == 0, F.concat(path, F.lit(".moved"))).otherwise(path)
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    after = docs.where("doc_id % 7 <> 3").select(
        F.col("source").alias("repo_id"), moved.alias("path"), text.alias("content")
    )
    return before, after


JOB_EVENTS_SQL = """
job_events AS (
  SELECT concat('job-', user_id) AS job_id, ts, event_id,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed'
                         WHEN 'error' THEN 'failed' ELSE 'active' END AS state,
         CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN concat('code ', event_id % 7) END AS reason
  FROM events)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = (
        F.when(kind == "signup", "queued")
        .when(kind == "purchase", "completed")
        .when(kind == "error", "failed")
        .otherwise("active")
    )
    reason = F.when((kind == "error") & (F.col("event_id") % 3 != 0), F.concat(F.lit("code "), F.col("event_id") % 7))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("job-"), "user_id").alias("job_id"),
        F.col("ts"),
        "event_id",
        state.alias("state"),
        reason.alias("reason"),
    )
