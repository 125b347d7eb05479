"""Reads and changes of chunk and document tables as plain DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators import filters as FL
from corpuscle.operators import quality


def get_document(table: DataFrame, id_: object) -> DataFrame:
    """One record by id, absent text as ''."""
    return table.where(F.col("id") == F.lit(id_)).withColumn("content", F.coalesce("content", F.lit("")))


def get_documents(table: DataFrame, ids: DataFrame | list) -> DataFrame:
    """The records that exist among ``ids``; short lists are pushed into the scan.

    ``ids`` with a ``repo_id`` name records of that repository only.
    """
    if isinstance(ids, list):
        found = table.where(F.col("id").isin(ids))
    else:
        key = _key_of(ids)
        found = table.join(ids.select(*key), key, "left_semi")
    return found.withColumn("content", F.coalesce("content", F.lit("")))


def _key_of(ids: DataFrame) -> list[str]:
    return ["repo_id", "id"] if "repo_id" in ids.columns else ["id"]


def get_parents(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents by ``(repo_id, id)``."""
    return table.join(wanted.select("repo_id", "id"), ["repo_id", "id"], "left_semi")


def chunks_by_file(table: DataFrame, repo_id: str, file_path: str) -> DataFrame:
    return table.where((F.col("repo_id") == repo_id) & (F.col("file_path") == file_path))


def first_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order. Copies are reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("_row")).select(*key, "_row.*").select(*rows.columns)


def upsert(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Base rows whose key is not among the new ones, plus the new ones; fails on a key that is twice among them."""
    once = quality.require_unique(new, key).where("copies = 1")  # read here, or the check would be pruned
    return base.join(once, key, "left_anti").unionByName(new)


def clean(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content", text.sanitize(F.col("content")))


def parent_rows(rows: DataFrame) -> DataFrame:
    """Documents ready to be stored: clean text, repository and metadata defaults."""
    return clean(rows).withColumn("repo_id", F.coalesce("repo_id", F.lit("no-repo")))


def delete_ids(table: DataFrame, ids: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows whose key is not among ``ids``: ``(repo_id, id)`` where ``ids`` has both, else ``id``."""
    key = key or _key_of(ids)
    return table.join(ids.select(*key), key, "left_anti")


def delete_where(table: DataFrame, filters: dict) -> DataFrame:
    """Rows that do not match; an empty filter deletes nothing. Unknown (null) never matches."""
    condition = FL.metadata_filter(filters)
    return table if condition is None else table.where(~F.coalesce(condition, F.lit(False)))


def count(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n"))


def repo_ids(table: DataFrame) -> DataFrame:
    return table.where(F.col("repo_id").isNotNull()).select("repo_id").distinct()


def file_paths_head(table: DataFrame, n: int = 20, path: str = "file_path") -> DataFrame:
    """First n distinct paths, each row with the number of paths not shown."""
    paths = table.where(F.col(path).isNotNull()).select(path).distinct()
    total = paths.agg(F.count(F.lit(1))).scalar()
    return paths.orderBy(path).limit(n).select(path, F.greatest(total - n, F.lit(0)).alias("more"))


def sample_head(table: DataFrame, n: int = 10) -> DataFrame:
    """The first records with short previews."""
    def known(name: str) -> Column:
        value = F.col(name) if name in table.columns else F.lit(None).cast("string")
        return F.coalesce(value.cast("string"), F.lit("N/A")).alias(name)

    return (
        table.orderBy("id")
        .limit(n)
        .select(
            "id", known("file_path"), known("function_name"), known("chunk_type"), known("repo_id"),
            text.preview(F.coalesce("content", F.lit(""))).alias("preview"),
        )
    )


def batch_count(n: Column, batch: int = 1000) -> Column:
    return F.ceil(n / F.lit(batch)).cast("long")
