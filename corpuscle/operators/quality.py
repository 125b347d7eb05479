"""Audits of chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text


def duplicate_ids(table: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once and how often."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_summary(table: DataFrame, key: list[str]) -> DataFrame:
    """``total, unique_ids, duplicates`` of the whole table."""
    per_key = table.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique_ids")
    ).withColumn("duplicates", F.col("total") - F.col("unique_ids"))


def require_unique(table: DataFrame, key: list[str]) -> DataFrame:
    """One row per key; fails the job where a key occurs twice."""
    per_key = table.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    message = F.concat(F.lit("duplicate id: "), F.concat_ws(":", *key))
    return per_key.select(
        *key, F.when(F.col("copies") > 1, F.raise_error(message).cast("long")).otherwise(F.col("copies")).alias("copies")
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Per file: chunks found, kept, dropped as blank, distinct ids, characters."""
    blank = text.is_blank(F.col("content"))
    per_id = chunks.groupBy("repo_id", "file_path", "id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~blank).alias("valid"), F.sum(F.length("content")).alias("chars")
    )
    return per_id.groupBy("repo_id", "file_path").agg(
        F.sum("n").alias("extracted"),
        F.sum("valid").alias("valid"),
        (F.sum("n") - F.sum("valid")).alias("dropped"),
        F.count(F.lit(1)).alias("unique_ids"),
        F.sum("chars").alias("chars"),
    )


def text_sizes(parents: DataFrame) -> DataFrame:
    """Characters per repository, and how many of them cleaning takes away."""
    clean = F.length(text.sanitize(F.col("content")))
    return parents.groupBy("repo_id").agg(
        F.sum(F.length("content")).alias("chars"), F.sum(F.length("content") - clean).alias("removed_chars")
    )
