"""Chunks of documents: lines, and blocks of lines (headings, tables, lists, code, paragraphs).

All work happens inside the document's own row: arrays of lines, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions import text


def chunk_id(path: Column, name: Column, kind: Column, line: Column) -> Column:
    return F.concat(path, F.lit(":"), name, F.lit(":"), kind, F.lit(":L"), line.cast("string"))


def name_from_id(id_: Column) -> Column:
    """Second part of an id; ``anonymous`` where it is empty."""
    return F.coalesce(F.nullif(F.split_part(id_, F.lit(":"), F.lit(2)), F.lit("")), F.lit("anonymous"))


def numbered_lines(content: Column) -> Column:
    return F.transform(F.split(content, "\n"), lambda line, i: F.struct((i + 1).alias("line"), line.alias("content")))


def paragraphs(documents: DataFrame, path: str = "id", content: str = "content") -> DataFrame:
    """One chunk per non-blank line, numbered in order: ``chunk_index`` counts kept lines only."""
    kept = F.filter(numbered_lines(F.col(content)), lambda l: ~text.is_blank(l["content"]))
    rest = [c for c in documents.columns if c != content]
    rows = documents.select(*rest, F.posexplode(kept).alias("chunk_index", "_l"))
    kind = F.lit("paragraph")
    return rows.select(
        *[c for c in rest if c != "id"],
        chunk_id(F.col(path), F.lit("anonymous"), kind, F.col("_l.line")).alias("id"),
        F.col(path).alias("file_path"),
        F.lit("anonymous").alias("name"),
        kind.alias("chunk_type"),
        "chunk_index",
        F.col("_l.content").alias("content"),
        F.col("_l.line").alias("start_line"),
        F.col("_l.line").alias("end_line"),
    )


# Classes of lines. An indented line goes on with a list item above it, else it is text.
BLANK, HEADING, TABLE, LIST, TICKS, TILDES, INDENTED, TEXT = range(8)
KINDS = {HEADING: "heading", TABLE: "table", LIST: "list", TICKS: "code_block", TEXT: "paragraph"}
_CLASSES = [
    (TICKS, r"^ {0,3}```"),
    (TILDES, r"^ {0,3}~~~"),
    (HEADING, r"^ {0,3}#{1,6}(?:[ \t]|$)"),
    (TABLE, r"^[ \t]*\|"),
    (LIST, r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+[^ \t]"),
    (INDENTED, r"^(?: {2}|\t)"),
]
_SPANS = T.StructType([T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("first", "last", "kind")])


def _class(line: Column) -> Column:
    found = F.when(text.is_blank(line), BLANK)
    for number, pattern in _CLASSES:
        found = found.when(line.rlike(pattern), number)
    return found.otherwise(TEXT)


def _fenced(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines from each fence to the next of its sort, or to the end, as code, and where fences open."""
    kinds, opens, at = kinds.copy(), np.zeros(len(kinds), bool), 0
    fences = np.flatnonzero((kinds == TICKS) | (kinds == TILDES))
    for start in fences:
        if start >= at:
            same = fences[(fences > start) & (kinds[fences] == kinds[start])]
            at = int(same[0]) + 1 if len(same) else len(kinds)
            kinds[start:at] = TICKS
            opens[start] = True
    return kinds, opens


@F.pandas_udf(_SPANS)
def _spans(classes: pd.Series) -> pd.DataFrame:
    """Islands of lines of one class, as numbers of first and last lines from 0; blank lines lie between them."""
    out = []
    for found in classes:
        kinds, opens = _fenced(np.asarray(found, np.int64))
        place = np.arange(len(kinds))
        leading = np.maximum.accumulate(np.where(kinds != INDENTED, place, -1))
        above = np.where(leading >= 0, kinds[leading], TEXT)
        kinds = np.where(kinds == INDENTED, np.where(above == LIST, LIST, TEXT), kinds)
        begins = np.ones(len(kinds), bool)
        begins[1:] = kinds[1:] != kinds[:-1]
        first = np.flatnonzero(begins | (kinds == HEADING) | opens)
        last = np.append(first[1:], len(kinds)) - 1
        kept = kinds[first] != BLANK
        out.append([a[kept].astype(np.int32) for a in (first, last, kinds[first])])
    return pd.DataFrame(out, columns=["first", "last", "kind"])


def prose_blocks(documents: DataFrame, path: str = "id", content: str = "content") -> DataFrame:
    """One chunk per block of lines: ``heading``, ``table``, ``list``, ``code_block`` or ``paragraph``.

    A heading is a line of its own, its text is the chunk's name; a code block reaches from a fence to the next of its
    sort or to the end; indented lines belong to the list item above them. Other columns are kept but for ``id``.
    """
    rest = [c for c in documents.columns if c != content]
    rows = documents.select(*rest, F.split(F.col(content), "\n").alias("_lines"))
    spans = rows.withColumn("_spans", _spans(F.transform("_lines", _class)))
    zipped = F.arrays_zip(F.col("_spans.first").alias("first"), F.col("_spans.last").alias("last"), F.col("_spans.kind").alias("kind"))
    rows = spans.where("_lines is not null").select(*rest, "_lines", F.posexplode(zipped).alias("chunk_index", "_s"))
    body = F.array_join(F.slice("_lines", F.col("_s.first") + 1, F.col("_s.last") - F.col("_s.first") + 1), "\n")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("_s.kind"))
    title = F.regexp_extract(body, r"^ {0,3}#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$", 1)
    named = rows.select(*rest, "chunk_index", body.alias("_body"), kind.alias("chunk_type"), (F.col("_s.first") + 1).alias("start_line"), (F.col("_s.last") + 1).alias("end_line"),
                        F.when(F.col("_s.kind") == HEADING, F.nullif(title, F.lit(""))).alias("_title"))
    name = F.coalesce("_title", F.lit("anonymous"))
    return named.select(
        *[c for c in rest if c != "id"],
        chunk_id(F.col(path), name, F.col("chunk_type"), F.col("start_line")).alias("id"),
        F.col(path).alias("file_path"), name.alias("name"), "chunk_type", "chunk_index", F.col("_body").alias("content"), "start_line", "end_line",
    )
