"""Chat requests for language models: routing and message building.

The engine only prepares requests; calling a model is left to a UDF the user
supplies (:func:`generate`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Model name prefix -> provider, first match wins.
PROVIDERS = [("gpt", "openai"), ("claude", "anthropic")]


def route(model: Column) -> Column:
    """Provider for a model name by case-insensitive prefix; null where none serves it."""
    return F.coalesce(*[F.when(model.rlike(f"(?i)^{prefix}"), F.lit(name)) for prefix, name in PROVIDERS])


def errors(prompt: Column, model: Column) -> Column:
    blank = F.coalesce(F.trim(prompt) == "", F.lit(True))
    return F.array_compact(
        F.array(
            F.when(blank, F.lit("prompt")),
            F.when(F.coalesce(model == "", F.lit(True)), F.lit("model")),
            F.when(route(model).isNull(), F.lit("provider")),
        )
    )


def build_request(
    prompt: Column,
    model: Column,
    instructions: Column,
    temperature: Column,
    max_tokens: Column,
    json_mode: Column,
) -> Column:
    """Request body as JSON text; absent options are left out."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = F.array_compact(
        F.array(
            F.when(F.coalesce(instructions != "", F.lit(False)), message("system", instructions)),
            message("user", prompt),
        )
    )
    json_format = F.when(json_mode, F.struct(F.lit("json_object").alias("type")))
    return F.to_json(
        F.struct(
            model.alias("model"),
            messages.alias("messages"),
            temperature.alias("temperature"),
            max_tokens.alias("max_tokens"),
            json_format.alias("response_format"),
        )
    )


def generate(
    requests: DataFrame, load_model: Callable[[], Callable[[list[str]], list[str]]], out: str = "answer"
) -> DataFrame:
    """Answer each row's ``request`` with a model that is loaded once per Python worker."""

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for bodies in batches:
            yield pd.Series(model(bodies.tolist()))

    return requests.withColumn(out, call(F.col("request")))


def context_pack(hits: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Retrieved contents of each query in rank order as one context text.

    A query has at most 3*100 hits, so the collected group is small by contract.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "content")))
    return hits.groupBy("query_id").agg(
        F.concat_ws(separator, F.transform(ranked, lambda r: r["content"])).alias("context")
    )
