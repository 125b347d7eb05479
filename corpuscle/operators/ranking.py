"""Row numbers and look-ups for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spread_row_number(df: DataFrame, group: list[str], key: str, out: str = "nth") -> DataFrame:
    """1-based number of each row within its group, ordered by ``(md5(key)[:2], key)``.

    A group may hold a large part of the table, so it is never numbered in one
    task: it is cut into 256 slices by the hash of ``key``, rows are numbered
    within their slice, and each slice starts after the rows of the slices
    before it. Slice sizes come from a partial aggregation; at most 256 per
    group enter the running sum.
    """
    sliced = df.withColumn("_slice", F.substring(F.md5(key), 1, 2))
    sizes = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_slice").orderBy(key)
    numbered = sliced.withColumn("_row", F.row_number().over(within))
    return (
        numbered.join(starts, [*group, "_slice"])
        .withColumn(out, F.col("_start") + F.col("_row"))
        .drop("_slice", "_row", "_start")
    )


BROADCAST_ROWS = 100_000
SALTS = 64


def attach(rows: DataFrame, details: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join of ``details`` (one row per key) where a key may own a large part of ``rows``.

    A counted, small detail table is broadcast. A larger one is repeated once per
    salt, and rows of one key are spread over the salts by their ``spread`` column.
    """
    if details.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(details), key, "left")
    salted = details.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    slot = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", slot).join(salted, [key, "_salt"], "left").drop("_salt")
