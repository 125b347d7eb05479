"""Code chunks: one row per class, function, section, pair ... of every file.

A file is one row, and all that chunking needs is in it, so the whole operator
is a narrow projection: a broadcast join brings the language's patterns to the
row, regular expressions cut the text into units and find block headers, a
small numpy helper adds up offsets and finds where blocks close, and the hits
are exploded. Nothing is shuffled, and cost grows linearly with the text.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions import path as P
from corpuscle.functions import text as X
from corpuscle.operators.chunking import lexing, nesting
from corpuscle.operators.chunking.languages import EXTENSIONS
from corpuscle.operators.chunking.prose import chunk_id
from corpuscle.operators.chunking.rules import LANGUAGES

_NEVER = r"^\b\B"
_DECORATOR = r"\A\s*@\w[^{]*\z"
_EMPTY = r"^\z"
_DEEP = 1 << 29
_VOID = "area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr"
_RULE = "struct<no:int,node:string,pattern:string,end:string,named:boolean>"


def dimension(spark: SparkSession) -> DataFrame:
    """One row per extension with the patterns of its language: fixed, some 70 rows."""
    rows = []
    seen: set[str] = set()
    for name, language in LANGUAGES.items():
        found = lexing.patterns(language.style)
        options = language.options
        rules = [
            (no, node, pattern, end, _groups(pattern) > 1) for no, (node, pattern, end) in enumerate(language.rules)
        ]
        split = options.get("split", lexing.SPLITS.get(language.family))
        mark = lexing.FENCE if language.style == "markdown" else lexing.STRING
        for ext in EXTENSIONS[name]:
            if ext in seen:
                continue
            seen.add(ext)
            rows.append(
                (
                    ext, name, language.family, found["lex"], found["comment"], found["string"], split, mark,
                    options.get("context", _DECORATOR), options.get("opens", _NEVER), options.get("closes", _NEVER),
                    options.get("heading", _NEVER), options.get("subheading", _NEVER), language.nested,
                    _anchored([pattern for _, pattern, _ in language.rules]), rules,
                )
            )
    return spark.createDataFrame(
        rows,
        "ext string, language string, family string, _lex string, _comment string, _string string, _split string,"
        "_mark string, _context string, _opens string, _closes string, _heading string, _subheading string,"
        "_nested boolean, _any string,"
        f"_rules array<{_RULE}>",
    )


def _bare(pattern: str) -> str:
    """The pattern with its flags kept to itself, fit for an alternation."""
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    return f"(?{flags[1]}:{pattern[flags.end():]})" if flags else pattern


def _anchored(patterns: list[str]) -> str:
    """One pattern for all, which begin with ``^`` each, tried at the start alone and not at every character."""
    return r"\A(?:" + "|".join(f"(?:{_bare(p)})" for p in patterns) + ")"


def _groups(pattern: str) -> int:
    """Number of capturing groups."""
    plain = re.sub(r"\[(?:\\.|[^\]\\])+\]", "", re.sub(r"\\.", "", pattern))
    return len(re.findall(r"\((?!\?)", plain))


def _first_at_most(levels: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each i the first j > i with levels[j] <= bounds[i], or the length."""
    out = np.full(len(levels), len(levels))
    pending: list[int] = []
    limits = bounds.tolist()
    for j, level in enumerate(levels.tolist()):
        while pending and level <= limits[pending[-1]]:
            out[pending.pop()] = j
        pending.append(j)
    return out


_LAYOUT = ["off", "line", "ctx", "prev", "close", "wide"]


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array of lists, and where each list begins and the last one ends."""
    values = lists.values.dictionary_encode().indices if pa.types.is_string(lists.type.value_type) else lists.values
    return values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


@F.arrow_udf(T.StructType([T.StructField(name, T.ArrayType(T.IntegerType())) for name in _LAYOUT]))
def _layout(lens: pa.Array, breaks: pa.Array, kinds: pa.Array, values: pa.Array, bounds: pa.Array, groups: pa.Array) -> pa.Array:
    """Byte offsets, line numbers, start of preceding comments, previous code unit and closing unit.

    With ``bounds`` the values are levels, and a block reaches up to the next unit
    at or below its bound; without, they are nesting changes (per group, if given).
    A batch is held in flat arrays, not as an object for each file and column.
    """
    arrays = [_flat(a) for a in (lens, breaks, kinds, values, bounds, groups)]
    bounded, grouped = (np.asarray(a.is_valid()) for a in (bounds, groups))
    starts = np.concatenate([[0], np.cumsum(np.diff(arrays[0][1]))])
    made = [np.empty(starts[-1], np.int32) for _ in _LAYOUT]
    for i in range(len(lens)):
        length, newline, kind, value, bound, group = (a[at[i] : at[i + 1]] for a, at in arrays)
        n = len(length)
        position = np.arange(n)
        code = np.maximum.accumulate(np.where(kind == 0, position, -1)) if n else position
        prev = np.concatenate([[-1], code[:-1]])[:n]
        context = np.minimum.accumulate(np.where(kind > 1, position, n)[::-1])[::-1] if n else position
        ctx = np.minimum(np.append(context, n)[prev + 1], position)
        if bounded[i]:
            after = np.append(code, code[-1] if n else -1)
            close = np.maximum(after[_first_at_most(value, bound) - 1], position)
            wide = np.maximum(after[_first_at_most(value, np.minimum(bound, value) - 1) - 1], position)
        else:
            close = wide = _closing(value, group if grouped[i] else None, position)
        off = np.concatenate([[0], np.cumsum(length)[:-1]])[:n]
        line = 1 + np.concatenate([[0], np.cumsum(newline)[:-1]])[:n]
        for column, found in zip(made, (off, line, ctx, prev, close, wide)):
            column[starts[i] : starts[i + 1]] = found
    offsets = pa.array(starts.astype(np.int32))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(c)) for c in made], names=_LAYOUT)


def _closing(value: np.ndarray, group, position: np.ndarray) -> np.ndarray:
    close = position.copy()
    changing = np.flatnonzero(value)
    members = [changing] if group is None else [changing[group[changing] == g] for g in np.unique(group[changing])]
    for chosen in members:
        change = value[chosen]
        level = np.cumsum(change)
        found = _first_at_most(level, level - np.maximum(change, 1))
        ends = np.append(chosen, position[-1:])[np.minimum(found, len(chosen))]
        close[chosen] = np.where(change > 0, ends, chosen)
    return close


def _values(units: Column) -> Column:
    """Nesting change or level of each unit, by the language's family."""
    family = F.col("family")

    def count(u: Column, pattern: str) -> Column:
        return F.regexp_count(u, F.col(pattern))

    def last(u: Column, opening: str, closing: str) -> Column:
        tail = F.right(u, F.lit(1))
        return F.when(tail.isin(list(opening)), 1).when(tail.isin(list(closing)), -1).otherwise(0)

    indent = lambda u: F.length(F.regexp_extract(u, r"\A[ \t]*", 0))
    hashes = lambda u: F.length(F.regexp_extract(u, r"\A[ ]{0,3}(#{1,6})(?=[ \t\n]|\z)", 1))
    idle = lexing.idle
    tag = lambda u: (
        F.when(u.rlike(rf"(?si)\A<(?:[!?]|script\b|style\b|(?:{_VOID})\b)|/>\z|\A[^<]"), 0)
        .when(u.startswith("</"), -1).otherwise(1)
    )
    heading = lambda u: (
        F.when(F.col("language") == "markdown", F.when(u.contains("#"), F.coalesce(F.nullif(hashes(u), F.lit(0)), F.lit(99))).otherwise(99))
        .when(lexing.matches(u, F.col("_heading")), 0).when(lexing.matches(u, F.col("_subheading")), 1).otherwise(2)
    )
    yaml = lambda u: indent(u) * 2 + F.regexp_like(u, F.lit(r"\A\s*-(?:\s|\z)")).cast("int")
    each = lambda fn: F.transform(units, lambda u: fn(u).cast("int"))
    return (
        F.when(family == "brace", each(lambda u: last(u, "{", "}") + count(u, "_opens") - count(u, "_closes")))
        .when(family == "keyword", each(lambda u: count(u, "_opens") - count(u, "_closes")))
        .when(family == "indent", each(lambda u: F.when(idle(u), _DEEP).otherwise(indent(u) + count(u, "_closes"))))
        .when(family == "yaml", each(lambda u: F.when(idle(u), _DEEP).otherwise(yaml(u))))
        .when(family == "heading", each(lambda u: F.when(idle(u), _DEEP).otherwise(heading(u))))
        .when(family == "paren", each(lambda u: u.startswith("(").cast("int") - u.endswith(")").cast("int")))
        .when(family == "json", each(lambda u: last(u, "{[", "}]")))
        .when(family == "tag", each(tag))
        .otherwise(each(lambda u: F.lit(0)))
    )


def _bounds() -> Column:
    leveled = F.col("family").isin("indent", "yaml", "heading")
    own = F.transform("_value", lambda v: F.when((F.col("language") == "markdown") & (v > 6), 6).otherwise(v))
    return F.when(leveled, own)


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def _group(unit: Column, rule: Column, group: int) -> Column:
    return F.call_function("regexp_extract", unit, rule["pattern"], F.lit(group))


def _candidates() -> Column:
    """Units that may be headers: one look at all rules together sorts out the rest."""
    may = F.transform(
        "_units", lambda u, i: F.when((_at("_kind", i) == 0) & lexing.matches(u, F.col("_any")), F.struct(i.alias("i"), u.alias("u")))
    )
    return F.filter(may, lambda c: c.isNotNull())


def _hits() -> Column:
    """Headers found by each rule. Rules are the outer loop, so a pattern is compiled once per file."""
    def by_rule(rule: Column) -> Column:
        found = F.filter("_candidates", lambda c: lexing.matches(c["u"], rule["pattern"]))
        return F.transform(found, lambda c: F.struct(c["i"].alias("i"), rule.alias("rule")))

    return F.flatten(F.transform("_rules", by_rule))


def _admitted(h: Column) -> Column:
    i, end = h["i"], h["rule"]["end"]
    prev = F.get(F.col("_layout.prev"), i)
    before = F.slice("_kind", F.get(F.col("_layout.ctx"), i) + 1, i - F.get(F.col("_layout.ctx"), i))
    first_item = (prev < 0) | F.regexp_like(_at("_units", prev), F.lit(r":\s*\z|\A---"))
    return (
        F.when(end == "body", _at("_value", i) > 0)
        .when(end == "decorated", F.array_contains(before, 3))
        .when(end == "sequence", first_item)
        .when(end == "first", prev < 0)
        .otherwise(True)
    )


def _layout_at(name: str, i: Column) -> Column:
    return F.get(F.col(f"_layout.{name}"), i)


_EXPORTED = r"\b(?:export|declare)\b"


def _headed(h: Column) -> Column:
    """Where a hit starts: after what precedes it, or at the comments and decorators above it."""
    i, rule = h["i"], h["rule"]
    return F.struct(
        i.alias("i"), rule.alias("rule"),
        _group(_at("_units", i), rule, 1).alias("prefix"),
        F.when(rule["named"], _group(_at("_units", i), rule, 2)).alias("name"),
        _layout_at("ctx", i).alias("ctx"),
        F.when(rule["end"].isin("self", "head", "value"), i)
        .when(rule["end"] == "sequence", _layout_at("wide", i))
        .otherwise(_layout_at("close", i))
        .alias("close"),
    )


def _bounded(h: Column) -> Column:
    """What comes before the start in its unit, and the text of the last unit without what follows the block."""
    i, end, prefix = h["i"], h["rule"]["end"], h["prefix"]
    plain = ~F.regexp_like(prefix, F.lit(_EXPORTED))
    marked = F.regexp_like(prefix, F.lit(r"[@\x01]"))
    lead = (
        F.when((h["ctx"] < i) & plain, F.regexp_extract(_at("_units", h["ctx"]), r"\A[\s\x04]*", 0))
        .when(marked & plain, F.regexp_extract(prefix, r"\A[\s\x04]*", 0))
        .otherwise(prefix)
    )
    after = F.when(
        (end == "tail") & ~F.regexp_like(_at("_units", h["close"]), F.lit(r"[;\n]\z"))
        & F.regexp_like(_at("_units", h["close"] + 1), F.lit(r"\A[^{};\n]*;\z")),
        _at("_units", h["close"] + 1),
    )
    text = _at("_units", h["close"])
    closes_parent = (F.col("family") == "brace") & (h["close"] == i) & (_at("_value", i) < 0)
    final = (
        F.when(end == "head", F.regexp_replace(text, r"\s*[{;]?\s*\z", ""))
        .when(closes_parent, F.regexp_replace(text, r"\s*\}\s*\z", ""))
        .when(end == "value", F.regexp_replace(text, r"\s*[,}\]]?\s*\z", ""))
        .when(after.isNotNull(), after)
        .otherwise(F.regexp_replace(text, r"[\s\x01\x04]+\z", ""))
    )
    return F.struct(
        i.alias("i"), h["rule"].alias("rule"), prefix.alias("prefix"), h["name"].alias("name"),
        F.when(plain, h["ctx"]).otherwise(i).alias("ctx"), lead.alias("lead"),
        F.when(after.isNotNull(), h["close"] + 1).otherwise(h["close"]).alias("last"), final.alias("final"),
    )


def _located(h: Column) -> Column:
    """Start and end in bytes, lines and name of a hit."""
    i, rule, last = h["i"], h["rule"], h["last"]
    quoted = F.substring(
        F.col("_bytes"), _layout_at("off", i) + F.octet_length(h["prefix"]) + 1, F.octet_length(h["name"])
    ).cast("string")
    late = F.when((rule["end"] == "tail") & rule["named"], F.regexp_extract(h["final"], r"\A\s*(\w+)\s*;\z", 1))
    name = F.when(h["name"].startswith(lexing.STRING), quoted).otherwise(
        F.coalesce(F.nullif(F.trim(h["name"]), F.lit("")), F.nullif(late, F.lit("")), F.lit("anonymous"))
    )
    return F.struct(
        (_layout_at("line", h["ctx"]) + lexing.newlines(h["lead"])).cast("int").alias("start_line"),
        rule["node"].alias("chunk_type"),
        name.alias("name"),
        (_layout_at("off", h["ctx"]) + F.octet_length(h["lead"])).cast("int").alias("start"),
        (-(_layout_at("off", last) + F.octet_length(h["final"]))).cast("int").alias("neg_stop"),
        rule["no"].alias("no"),
        (_layout_at("line", last) + lexing.newlines(h["final"])).cast("int").alias("end_line"),
    )


def _is_first(ordered: str, h: Column, i: Column) -> Column:
    """Whether a hit is the first of those with equal line, type and name.

    Sorted by these three, equal hits are neighbours. The sorted array has to be
    a column of its own, or it would be sorted again for every element.
    """
    before = F.get(F.col(ordered), i - 1)
    same = (before["start_line"] == h["start_line"]) & (before["chunk_type"] == h["chunk_type"]) & (before["name"] == h["name"])
    return (i == 0) | ~same


def _ordinals(starts: str, ordered: str) -> Column:
    """Numbers from 1 within each run of equal hits, from the places where runs start, a column of its own as well."""
    runs = F.transform(
        F.col(starts), lambda at, r: F.sequence(F.lit(1), F.coalesce(F.get(F.col(starts), r + 1), F.size(F.col(ordered))) - at)
    )
    return F.flatten(runs)


@functools.cache
def _columns() -> dict[str, Column]:
    """The expressions of :func:`code_chunks` in order; they name columns only, so one set serves all calls."""
    def led(u: Column) -> Column:
        """Whether a unit that is not blank is context of the next: most need no look by the pattern."""
        none = (F.col("_context") == _EMPTY) | ((F.col("_context") == _DECORATOR) & ~u.contains("@"))
        return F.when(~none & lexing.matches(u, F.col("_context")), 3).otherwise(0)

    kind = F.transform(
        "_units",
        lambda u: F.when(lexing.idle(u), F.when(u.contains(lexing.COMMENT), 2).when(F.regexp_like(u, F.lit(r"\A\s*\z")), 1).otherwise(led(u)))
        .when(u.startswith("<!--"), 2)
        .otherwise(led(u)),
    )
    group = F.when(
        F.col("family") == "tag", F.transform("_units", lambda u: F.lower(F.regexp_extract(u, r"\A</?([\w-]+)", 1)))
    )
    layout = _layout(
        F.transform("_units", F.octet_length), F.transform("_units", lambda u: lexing.newlines(u).cast("int")),
        F.col("_kind"), F.col("_value"), F.col("_bound"), group,
    )
    in_order = F.transform(
        F.sort_array(F.transform("_kept", lambda h: F.struct(h["start"].alias("s"), h["neg_stop"], h["no"], h.alias("h")))),
        lambda o: o["h"],
    )

    def shaped(h: Column) -> Column:
        body = F.substring(F.col("_bytes"), h["start"] + 1, -h["neg_stop"] - h["start"]).cast("string")
        rest = [h[name].alias(name) for name in ("name", "chunk_type", "start_line", "end_line", "ordinal")]
        return F.struct(*rest, body.alias("content"))

    return {
        "_masked": lexing.masked(*[F.col(c) for c in ("_text", "_lex", "_comment", "_string", "_split", "_mark")]),
        "_hidden": nesting.nested(F.when(F.col("_nested"), F.col("_masked")), F.col("language")),
        "_units": lexing.units(F.col("_text"), F.col("_lex"), F.coalesce("_hidden", "_masked"), F.col("_split")),
        "_kind": kind,
        "_value": _values(F.col("_units")),
        "_bound": _bounds(),
        "_layout": layout,
        "_bytes": F.col("_text").cast("binary"),
        "_candidates": _candidates(),
        "_hits": F.filter(_hits(), _admitted),
        "_headed": F.transform("_hits", _headed),
        "_bounded": F.transform("_headed", _bounded),
        "_located": F.sort_array(F.transform("_bounded", _located)),
        "_starts": F.filter(F.transform("_located", lambda h, i: F.when(_is_first("_located", h, i), i)), lambda i: i.isNotNull()),
        "_ordinal": _ordinals("_starts", "_located"),
        "_kept": F.zip_with("_located", "_ordinal", lambda h, o: h.withField("ordinal", o)),
        "_chunks": F.filter(F.transform(in_order, shaped), lambda c: ~X.is_blank(c["content"])),
    }


def code_chunks(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Chunks of every file in a known language.

    Result: the file's other columns, then ``id, file_path, language, name, chunk_type,
    chunk_index, content, start_line, end_line``. Chunks nest, a class and its methods are
    all returned. Files in other languages give no rows. ``chunk_index`` counts chunks in
    document order without blank ones.

    All blocks are returned. Of those with equal line, type and name, ``#2``, ``#3`` ... follows the id from the second on.
    """
    rest = [c for c in files.columns if c not in (path, content)]
    rows = files.select(
        *rest, F.col(path).alias("file_path"), X.sanitize(F.col(content)).alias("_text"),
        P.extname_lower(F.col(path)).alias("ext"),
    ).join(F.broadcast(dimension(files.sparkSession)), "ext")
    columns = dict(_columns())
    chunks = columns.pop("_chunks")
    for name, column in columns.items():
        rows = rows.withColumn(name, column)
    # The array is exploded where it is computed: of a plain column Spark would infer a
    # filter on its size and push a copy of all the work below everything else.
    rows = rows.select(*rest, "file_path", "language", F.posexplode(chunks).alias("chunk_index", "_c"))
    return rows.select(
        *rest,
        F.concat(
            chunk_id(F.col("file_path"), F.col("_c.name"), F.col("_c.chunk_type"), F.col("_c.start_line")),
            F.when(F.col("_c.ordinal") > 1, F.concat(F.lit("#"), F.col("_c.ordinal").cast("string"))).otherwise(""),
        ).alias("id"),
        "file_path", "language", "_c.name", "_c.chunk_type", "chunk_index", "_c.content", "_c.start_line", "_c.end_line",
    )
