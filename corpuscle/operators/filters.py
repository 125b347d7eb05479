"""Predicates on chunk tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import meta as M
from corpuscle.functions import text

Primitive = str | int | float | bool


def metadata_filter(filters: dict[str, Primitive] | None, columns: list[str] | None = None) -> Column | None:
    """AND of typed equalities on columns; no filter for an empty mapping.

    A row without the key has a null there and so is never matched. Names that are
    not among ``columns`` (if given) are looked up in the ``meta`` map, whose values
    are JSON texts: there ``1`` and ``"1"`` differ as they should.
    """
    if not filters:
        return None

    def equals(key: str, value: Primitive) -> Column:
        if columns is None or key in columns:
            return F.col(key) == F.lit(value)
        return F.col("meta")[key] == F.lit(json.dumps(value, ensure_ascii=False))

    return reduce(lambda a, b: a & b, [equals(key, value) for key, value in filters.items()])


def apply_filter(df: DataFrame, filters: dict[str, Primitive] | None) -> DataFrame:
    condition = metadata_filter(filters, df.columns if "meta" in df.columns else None)
    return df if condition is None else df.where(condition)


def scope(repo_id: str, filters: dict[str, Primitive] | None = None) -> dict[str, Primitive]:
    """Filter of one repository plus user filters, which may not name reserved fields."""
    clash = sorted(set(filters or {}) & (set(M.RESERVED) | {"repo_id"}))
    if clash:
        raise ValueError(f"reserved metadata in filter: {', '.join(clash)}")
    return {"repo_id": repo_id, **(filters or {})}


def non_blank(df: DataFrame, content: str = "content") -> DataFrame:
    return df.where(~text.is_blank(F.col(content)))


def has_content(df: DataFrame, content: str = "content") -> DataFrame:
    return df.where(F.col(content).isNotNull() & (F.col(content) != ""))


def min_score(df: DataFrame, least: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= F.lit(least))


def cross_category(tables: list[DataFrame]) -> DataFrame:
    """Records of several categories as one wide table, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
