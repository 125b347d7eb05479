"""Embedding of texts as a column.

The default embedder is a hashed bag of words: Spark splits and hashes the
words, an Arrow UDF only counts bucket numbers with numpy. Models plug in
through :func:`embed_with`. A blank text has no vector (null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text

DIMENSIONS = 64


def _input(content: Column, max_tokens: int | None = None) -> Column:
    prepared = text.embed_prep(content)
    return F.when(~text.is_blank(content), text.truncate_tokens(prepared, max_tokens) if max_tokens else prepared)


def _buckets(content: Column, dim: int) -> Column:
    """Bucket number of each word: the first 32 bits of its MD5 modulo the dimension."""
    return F.transform(
        text.words(content), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    )


def hash_vector(content: Column, dim: int = DIMENSIONS) -> Column:
    """L2-normalised bucket counts as ``array<float>``; null without any word."""

    @F.pandas_udf("array<float>")
    def count(buckets: pd.Series) -> pd.Series:
        lengths = np.array([0 if b is None else len(b) for b in buckets], dtype=np.int64)
        rows = np.repeat(np.arange(len(buckets)), lengths)
        flat = np.concatenate([b for b in buckets if b is not None and len(b)] or [np.empty(0, dtype=np.int32)])
        counts = np.bincount(rows * dim + flat, minlength=len(buckets) * dim).reshape(len(buckets), dim)
        norm = np.sqrt((counts * counts).sum(axis=1))
        unit = (counts / np.maximum(norm, 1)[:, None]).astype(np.float32)
        return pd.Series([unit[i] if norm[i] else None for i in range(len(buckets))])

    return count(_buckets(_input(content), dim))


def embed(df: DataFrame, content: str = "content", out: str = "vector", dim: int = DIMENSIONS) -> DataFrame:
    return df.withColumn(out, hash_vector(F.col(content), dim))


def embed_with(
    df: DataFrame,
    load_model: Callable[[], Callable[[list[str]], list[list[float]]]],
    content: str = "content",
    out: str = "vector",
    max_tokens: int | None = None,
) -> DataFrame:
    """Embed with a model that is loaded once per Python worker and called per Arrow batch.

    ``max_tokens`` is the model's own input limit; without one, texts are sent whole.
    Vectors stay with their texts; blank texts are never sent and errors fail the task.
    """

    @F.pandas_udf("array<float>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            sent = texts[texts.notna()]
            vectors = pd.Series(model(sent.tolist()), index=sent.index, dtype=object) if len(sent) else sent
            yield vectors.reindex(texts.index).where(texts.notna(), None)

    return df.withColumn(out, call(_input(F.col(content), max_tokens)))
