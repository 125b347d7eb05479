"""What several operators need: inputs, scratch tables, slots of an order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def texts_of(docs: DataFrame, *more: str | Column) -> DataFrame:
    """``row, doc_id, text`` and the columns in ``more``; a null text is empty.

    ``row`` names a row by the hash of its id and text, so null and repeated ids are told
    apart by their texts, and rows that are equal in both have one name and one result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc_id, text).alias("row"), doc_id.alias("doc_id"), text.alias("text"), *more)


def plain_names(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage(docs)`` where the stage returns the columns it gets.

    Columns beside those of documents are numbered meanwhile, so that none of their names clashes with one the
    stage makes, or with another in case, or holds a dot.
    """
    inner = docs.toDF(*[c if c in DOCUMENT else f"column{k}" for k, c in enumerate(docs.columns)])
    return stage(inner).select(*inner.columns).toDF(*docs.columns)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes to the shared scratch folder and reads back: steps share the result, and lost executors don't redo it."""
    spark = df.sparkSession
    place = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def slot_bounds(ids: DataFrame, column: str, slots: int) -> list[int]:
    """At most ``slots - 1`` ascending cuts of a long column, so that the slots hold about as many rows each."""
    if slots < 2:
        return []
    shares = [k / slots for k in range(1, slots)]
    found = ids.agg(F.percentile_approx(column, F.array(*[F.lit(s) for s in shares]), F.lit(20 * slots)).alias("cuts")).first()
    return sorted(set(found["cuts"] or []))


def slot_of(column: Column, bounds: list[int]) -> Column:
    """The number of cuts below the value; a null counts as the smallest value."""
    if not bounds:
        return F.lit(0)
    at = F.coalesce(column, F.lit(-(2**63)))
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.size(F.filter(cuts, lambda c: c < at))


def slots_for(spark, at_least: int = 1) -> int:
    """As many slots as the session has shuffle partitions."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
