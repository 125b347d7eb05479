"""Row-level request validators returning the list of failed rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import meta, url


def _errors(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(failed, F.lit(code)) for code, failed in rules]))


def _unknown_fields(fields: Column, known: list[str]) -> Column:
    return F.size(F.array_except(fields, F.array(*[F.lit(k) for k in known]))) > 0


def search_request(prompt: Column, k: Column, meta_json: Column) -> Column:
    """Prompt must be text (empty is fine), k an integer of 1..100, meta flat."""
    return _errors(
        ("prompt", prompt.isNull()),
        ("k", F.coalesce((k != F.floor(k)) | (k < 1) | (k > 100), F.lit(False))),
        ("meta", ~meta.is_flat(meta_json)),
    )


def ingest_request(
    repo_url: Column, ref: Column, token: Column, user_id: Column, repo_id: Column, meta_json: Column
) -> Column:
    return _errors(
        ("repoUrl", ~url.is_http_url(repo_url)),
        ("ref", F.coalesce(F.length(ref) > 255, F.lit(False))),
        ("token", F.coalesce(F.length(token) > 500, F.lit(False))),
        ("userId", F.coalesce(user_id == "", F.lit(False))),
        ("repoId", F.coalesce((F.length(repo_id) > 255) | ~repo_id.rlike(r"^[a-zA-Z0-9_-]+\z"), F.lit(False))),
        ("meta", ~meta.is_flat(meta_json)),
    )


def json_request(requests: DataFrame, body: str, known: list[str]) -> Column:
    """Extra error for a JSON body that names fields outside ``known``."""
    names = F.json_object_keys(F.col(body))
    return F.when(_unknown_fields(names, known), F.array(F.lit("unknown"))).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def split_valid(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    ok = F.size(F.col(errors)) == 0
    return df.where(ok), df.where(~ok)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
