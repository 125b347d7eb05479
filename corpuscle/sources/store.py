"""Stored tables: Parquet cut into hash buckets of their key.

A change rewrites only the buckets that hold changed keys, with Spark's
dynamic partition overwrite, so a lost executor or a failed job leaves the old
files in place. Buckets come from a hash of the key, not from the repository,
so one huge repository is spread evenly; rows are sorted by repository and key
inside files, so a filter on either skips row groups.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.operators import filters as FL
from corpuscle.operators import keysets, quality

BUCKET = "bucket"


class Table:
    """A table stored under ``path`` whose rows are replaced by ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark = spark
        self.path = path
        self.key = key
        self.buckets = buckets
        self.schema = T.StructType([f for f in spark.createDataFrame([], schema).schema.fields])

    def bucket_of(self, *columns: Column) -> Column:
        return F.pmod(F.xxhash64(*(columns or [F.col(c) for c in self.key])), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        try:
            return self.spark.read.schema(full).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)

    def read(self) -> DataFrame:
        """All rows; each bucket also holds one row of nulls that keeps it in place when it empties."""
        return self._stored().where(F.col(self.key[0]).isNotNull()).drop(BUCKET)

    def lookup(self, **key: object) -> DataFrame:
        """Rows of one whole key; only its bucket is read."""
        values = [F.lit(key[c]).cast(self.schema[c].dataType) for c in self.key]
        match = FL.metadata_filter({c: key[c] for c in self.key})
        return self._stored().where(F.col(BUCKET) == self.bucket_of(*values)).where(match).drop(BUCKET)

    def dealt(self, rows: DataFrame, *key: str) -> DataFrame:
        """Rows from which new rows of this table are made, laid out by the bucket of their ``key``, for :meth:`replace`.

        A bucket is in as many parts as keep the cores busy, for the work on the rows follows.
        """
        columns = [F.col(c) for c in key]
        parts = 1 + 4 * self.spark.sparkContext.defaultParallelism // self.buckets
        part = F.pmod(F.hash(*columns), F.lit(parts))
        placed = rows.withColumns({"_bucket": self.bucket_of(*columns), "_part": part})
        return placed.hint("rebalance", "_bucket", "_part").drop("_bucket", "_part")

    def replace(self, new: DataFrame, touched: DataFrame, dealt: bool = False) -> None:
        """Rows of the ``touched`` keys become the new ones.

        Every new row's key has to be among the touched ones. ``touched`` should be
        cheap to read, for it is read several times: for its buckets, a list no longer than
        the number of buckets, and for the keys to drop. ``dealt`` tells that ``new`` is made of
        rows from :meth:`dealt` without moving them, so that it need not be laid out by bucket again.
        """
        keys = touched.select(*self.key)
        rows = keys.select(self.bucket_of().alias(BUCKET)).distinct().collect()
        numbers = sorted(r[BUCKET] for r in rows)
        if not numbers:
            return
        kept = self._stored().where(F.col(BUCKET).isin(numbers)).where(F.col(self.key[0]).isNotNull())
        kept = keysets.without(kept, keys, self.key)
        names = self.schema.fieldNames()
        fresh = new.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).withColumn(
            BUCKET, self.bucket_of()
        )
        anchors = self.spark.createDataFrame([(n,) for n in numbers], f"{BUCKET} int").select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], BUCKET
        )
        kept = kept.select(*names, BUCKET).unionByName(anchors)
        if dealt:
            full = kept.hint("rebalance", BUCKET).unionByName(fresh)
        else:
            full = kept.unionByName(fresh).hint("rebalance", BUCKET)
        order = list(dict.fromkeys([BUCKET, *(["repo_id"] if "repo_id" in names else []), *self.key]))
        (
            full.sortWithinPartitions(*order)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(BUCKET)
            .parquet(self.path)
        )

    def upsert(self, rows: DataFrame) -> None:
        """Insert or replace rows by key; fails before anything is written where a key is twice in ``rows``."""
        twice = quality.duplicate_ids(rows, self.key).first()
        if twice:
            raise ValueError(f"duplicate key: {[twice[c] for c in self.key]}")
        self.replace(rows, rows)

    def delete(self, keys: DataFrame) -> None:
        self.replace(self.spark.createDataFrame([], self.schema), keys)

    def delete_where(self, filters: dict) -> None:
        """Delete by equality filter; an empty filter is refused."""
        condition = FL.metadata_filter(filters)
        if condition is None:
            return
        hit = self.read().where(condition)
        remaining = self.read().join(hit.select(*self.key), self.key, "left_semi").where(~F.coalesce(condition, F.lit(False)))
        self.replace(remaining, hit)

    def clear(self) -> int:
        """Drop all rows and tell how many there were; nothing happens to an empty table."""
        held = self.read()
        n = held.count()
        if n:
            self.delete(held)
        return n
