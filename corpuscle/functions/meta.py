"""User metadata: sanitising, merging, flatness.

Dynamic metadata travels as ``map<string,variant>`` (JSON input) or as typed
``map<string,V>``; the reserved names live in top-level columns, where filters
on them can be pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that user metadata may not set.
RESERVED = """
id category repositoryId repoId workspaceId userId timestamp filePath fileType
chunkIndex chunkType parentId functionName startLine endLine
""".split()

_EMPTY = "map()"


def variant_map(json_text: Column) -> Column:
    """JSON object text as ``map<string,variant>``; null for other or bad JSON."""
    parsed = F.try_parse_json(json_text)
    return F.when(_kind(parsed).startswith("OBJECT"), F.try_variant_get(parsed, "$", "map<string,variant>"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_primitive(value: Column) -> Column:
    """String, number or boolean variant (JSON null, arrays and objects are not)."""
    return F.coalesce(~_kind(value).rlike(r"^(VOID|ARRAY|OBJECT)"), F.lit(False))


def sanitize(meta: Column) -> Column:
    """Keep primitive values under names that are not reserved; absent map becomes empty."""
    kept = F.map_filter(meta, lambda k, v: is_primitive(v) & ~k.isin(RESERVED))
    return F.coalesce(kept, F.expr("cast(map() as map<string,variant>)"))


def sanitize_typed(meta: Column) -> Column:
    """The same for a map with one primitive value type: null values and reserved names go."""
    return F.map_filter(meta, lambda k, v: v.isNotNull() & ~k.isin(RESERVED))


def is_flat(json_text: Column) -> Column:
    """Absent metadata passes; otherwise an object whose values are all primitive."""
    flat = F.forall(F.map_values(variant_map(json_text)), is_primitive)
    return F.when(json_text.isNull(), F.lit(True)).otherwise(F.coalesce(flat, F.lit(False)))


def merge(base: Column, *later: Column) -> Column:
    """Map merge in which later maps win, whatever the session's dedup policy says."""
    merged = base
    for extra in later:
        merged = F.map_concat(_without_keys_of(merged, extra), extra)
    return merged


def _without_keys_of(meta: Column, other: Column) -> Column:
    return F.map_filter(meta, lambda k, v: ~F.coalesce(F.map_contains_key(other, k), F.lit(False)))


def keys(meta: Column) -> Column:
    return F.array_sort(F.map_keys(meta))


def to_json_text(meta: Column) -> Column:
    return F.to_json(meta)
