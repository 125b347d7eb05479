"""Chunks in every language: each document becomes a source file with known blocks and its text as a comment behind them."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from corpuscle.operators.chunking import blocks
from corpuscle.operators.chunking.languages import EXTENSIONS
from corpuscle.plans import testbed as TB
from corpuscle.plans.code_samples import AROUND, LINES, SAMPLES
from corpuscle.plans.registry import query

_LANGUAGE = {ext: name for name, found in reversed(list(EXTENSIONS.items())) for ext in found}
_CONTROL = r"[\x00-\x08\x0B-\x1F\x7F]"
_MARKS = "*-%"  # could end a comment


def _samples(family: str) -> list[tuple[str, str, str, str, list[tuple[str, str, int, int]]]]:
    """Extension, code, what each line of the comment begins with, what ends it, and the blocks, of all samples of a family."""
    out = []
    for path, (code, found) in SAMPLES.items():
        ext = os.path.splitext(path)[1]
        language = _LANGUAGE.get(ext)
        code = code if code.endswith("\n") else code + "\n"
        if language in LINES[family]:
            out.append((ext, code, LINES[family][language] + " ", "", found))
        elif language in AROUND[family]:
            opening, closing = AROUND[family][language]
            out.append((ext, code + opening, " ", closing, found))
    return out


def _sql(family: str) -> str:
    rows, n = [], 0
    for ext, _, _, _, found in _samples(family):
        seen: dict[tuple, int] = {}
        for i, (name, kind, first, last) in enumerate(found):
            nth = seen[name, kind, first] = seen.get((name, kind, first), 0) + 1
            quoted = name.replace("'", "''")
            rows.append(f"({n}, '{ext}', '{quoted}', '{kind}', {i}, {first}, {last}, '{f'#{nth}' if nth > 1 else ''}')")
        n += 1
    return f"""WITH s(k, ext, name, kind, i, first, last, nth) AS (VALUES {', '.join(rows)})
    SELECT source AS repo_id, concat('src/', doc_id, ext, ':', name, ':', kind, ':L', first, nth) AS id, concat('src/', doc_id, ext) AS file_path, name,
      kind AS chunk_type, i::INTEGER AS chunk_index, first::INTEGER AS start_line, last::INTEGER AS end_line
    FROM documents JOIN s ON doc_id % {n} = k"""


def _files(spark, sf, family: str):
    text = TB.swapped(F.regexp_replace("text", _CONTROL, ""), _MARKS, ".")
    ext = content = F.lit(None).cast("string")
    samples = _samples(family)
    for k, (end, code, mark, closing, _) in enumerate(samples):
        here = F.col("doc_id") % len(samples) == k
        note = F.concat(F.lit(code + mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)), F.lit(" " + closing + "\n"))
        ext, content = F.when(here, end).otherwise(ext), F.when(here, note).otherwise(content)
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), ext)
    return TB.wide_table(spark, sf, "documents").select(F.col("source").alias("repo_id"), path.alias("path"), content.alias("content"))


def _chunks(spark, sf, family: str):
    return blocks.code_chunks(_files(spark, sf, family)).drop("language", "content")


@query("chunks_script", _sql("script"))
def chunks_script(spark, sf):
    return _chunks(spark, sf, "script")


@query("chunks_braces", _sql("braces"))
def chunks_braces(spark, sf):
    return _chunks(spark, sf, "braces")


@query("chunks_words", _sql("words"))
def chunks_words(spark, sf):
    return _chunks(spark, sf, "words")


@query("chunks_data", _sql("data"))
def chunks_data(spark, sf):
    return _chunks(spark, sf, "data")
