"""Rows by whether their key is in a set of keys; the rows stay where they are.

A small set is broadcast. Of a larger one a bitmap of key hashes is broadcast, which is no larger than
``BITS`` for any set. It rules most rows in or out; keys that only share their bit with one of
the set are found by joining keys alone, and rows of these few are told apart by one more join.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.ranking import BROADCAST_ROWS
from corpuscle.session import written

BITS = 1 << 26  # 8 MB; a tenth of other keys is doubtful from seven million keys on
PAGE = 1 << 15  # bits of one of Spark's bitmaps


def _place(key: list[str]) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(*key), F.lit(BITS))
    return F.floor(at / PAGE).alias("_page"), F.pmod(at, F.lit(PAGE))


def _bitmaps(keys: DataFrame, key: list[str]) -> DataFrame:
    page, bit = _place(key)
    return keys.select(page, bit.alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def _marked(rows: DataFrame, bitmaps: DataFrame, key: list[str]) -> DataFrame:
    """Rows with ``_maybe``: false where the key is not in the set; a key with a null in it never is."""
    page, bit = _place(key)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = reduce(and_, [F.col(c).isNotNull() for c in key])
    maybe = known & F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
    return rows.withColumn("_page", page).join(F.broadcast(bitmaps), "_page", "left").select(*rows.columns, maybe.alias("_maybe"))


def _split(rows: DataFrame, keys: DataFrame, key: list[str], narrow: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_maybe``, and the keys of rows for which it is wrongly true."""
    bitmaps = written(_bitmaps(keys, key), "bitmaps")
    asked = _marked((rows if narrow is None else narrow).select(*key), bitmaps, key).where("_maybe").select(*key).distinct()
    return _marked(rows, bitmaps, key), written(asked.join(keys, key, "left_anti"), "doubtful")


def _plain(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame | None:
    """The keys for a join, where one will do: they are few, or their hashes differ from those in the rows by type."""
    if any(keys.schema[c].dataType != rows.schema[c].dataType for c in key):
        return keys
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else None


def within(rows: DataFrame, keys: DataFrame, key: list[str], narrow: DataFrame | None = None) -> DataFrame:
    """Rows whose key is among ``keys``, as a left semi join has them.

    ``keys`` and the keys of ``rows`` are read several times; ``narrow`` is a cheaper table with all keys of ``rows``.
    """
    keys = keys.select(*key)
    plain = _plain(rows, keys, key)
    if plain is not None:
        return rows.join(plain, key, "left_semi")
    marked, doubtful = _split(rows, keys, key, narrow)
    return marked.where("_maybe").join(doubtful, key, "left_anti").select(*rows.columns)


def without(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among ``keys``, as a left anti join has them; see :func:`within`."""
    keys = keys.select(*key)
    plain = _plain(rows, keys, key)
    if plain is not None:
        return rows.join(plain, key, "left_anti")
    marked, doubtful = _split(rows, keys, key, None)
    if doubtful.isEmpty():
        return marked.where("not _maybe").select(*rows.columns)
    apart = marked.where("_maybe").join(doubtful, key, "left_semi")
    return marked.where("not _maybe").unionByName(apart).select(*rows.columns)
