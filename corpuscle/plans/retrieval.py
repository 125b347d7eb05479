"""Search by prompt: requests in, documents or chunks out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import meta, text, validate
from corpuscle.operators import embed as E
from corpuscle.operators import search as S


def prepare(requests: DataFrame, dim: int = E.DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """Requests ``(query_id, repo_id, prompt[, k, meta])`` with vectors, and those that cannot be searched.

    ``meta`` is a JSON object of conditions, of which only values of one kind may be asked for; it may not name reserved
    fields. A blank prompt passes validation but has no embedding, so it is refused here.
    """
    told = requests if "meta" in requests.columns else requests.withColumn("meta", F.lit(None).cast("string"))
    told = told if "k" in told.columns else told.withColumn("k", F.lit(None).cast("double"))
    asked = meta.variant_map(F.col("meta"))
    names = F.coalesce(F.map_keys(asked), F.array().cast("array<string>"))
    failed = F.concat(
        F.transform(validate.search_request(F.col("prompt"), F.col("k"), F.col("meta")), lambda e: F.concat(F.lit("invalid "), e)),
        F.transform(F.array_intersect(names, F.array(*[F.lit(n) for n in meta.RESERVED])), lambda n: F.concat(F.lit("reserved metadata in filter: "), n)),
        F.when(text.is_blank(F.col("prompt")), F.array(F.lit("no embedding for the prompt"))).otherwise(F.array().cast("array<string>")),
    )
    judged = told.withColumn("_error", F.get(failed, F.lit(0)))
    entries = F.transform_values(meta.sanitize(asked), lambda _, v: F.to_json(v))
    vectors = E.embed(judged.where("_error is null").withColumn("meta", entries).drop("_error"), "prompt", "vector", dim)
    return vectors.where(F.col("vector").isNotNull()), judged.where("_error is not null").select("query_id", F.col("_error").alias("error"))


def _conditions(chunks: DataFrame, requests: DataFrame) -> dict:
    return {"meta": "meta"} if "meta" in chunks.columns and "meta" in requests.columns else {}


def search(requests: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Documents for each prompt, within the prompt's repository and the chunks that have all of its metadata."""
    return S.parent_child(chunks, parents, prepare(requests)[0], match_on=("repo_id",), **_conditions(chunks, requests))


def search_chunks(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks for each prompt, within the prompt's repository and the chunks that have all of its metadata."""
    return S.search_chunks(chunks, prepare(requests)[0], match_on=("repo_id",), **_conditions(chunks, requests))
