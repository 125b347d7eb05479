"""Repeated passages of words, found by recompression.

A round replaces equal neighbours by one run symbol and neighbours of a left and a right
symbol by one pair symbol; the side of a symbol is a bit of its name. Names are hashes of what
they stand for, so all executors give equal content the same name and a round needs no
dictionary. A symbol remembers which words its formation depended on. A window that covers
those words holds the symbol wherever else the window occurs. Each window is filed under its
highest such symbol, so equal windows meet under one name; windows that meet are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import hashing as H
from corpuscle.llm.common import scratch, texts_of

ROUNDS = 6
RUN_ROUNDS = (0, 3)
BYTES_AT_ONCE = 3 << 20
U = np.uint64

WINDOWS = "key long, ctx long, doc_id long, most long, off int, window long"
FILED = "row long, doc_id long, lo int, n int, key long, ctx long"


class Level:
    """The symbols after a round: their names, and the first and last word they depend on."""

    def __init__(self, name, lo, hi, text):
        self.name, self.lo, self.hi, self.text = name, lo, hi, text

    def joins(self):
        """Whether a symbol and the next belong to one text."""
        return self.text[1:] == self.text[:-1]


def name_runs(level: Level, edge: np.ndarray) -> Level:
    """Maximal runs of one symbol become one. That they are maximal depends on their neighbours."""
    same = level.joins() & (level.name[1:] == level.name[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    tail = np.concatenate([head[1:] - 1, [len(level.name) - 1]])
    size = tail - head + 1
    name = level.name[head]
    name = np.where(size > 1, H.blend(name, size.astype(np.uint64), 11), name)
    text = level.text[head]
    before, after = head - 1, tail + 1
    has_before = (before >= 0) & (level.text[before] == text)
    has_after = after < len(level.name)
    has_after &= level.text[np.minimum(after, len(level.name) - 1)] == text
    lo = np.where(has_before, level.lo[before], edge[text] - 1)
    hi = np.where(has_after, level.hi[np.minimum(after, len(level.name) - 1)], edge[text + 1] + 1)
    return Level(name, lo, hi, text)


def name_pairs(level: Level, edge: np.ndarray, seed: int) -> Level:
    """A left symbol before a right one becomes a pair. A symbol that stays depends on the neighbour it lacked."""
    right = (H.mix(level.name + U(seed)) & U(1)).astype(bool)
    pair = level.joins() & ~right[:-1] & right[1:]
    first = np.concatenate([pair, [False]])
    second = np.concatenate([[False], pair])
    keep = np.flatnonzero(~second)
    mate = np.minimum(keep + 1, len(level.name) - 1)
    paired = first[keep]
    name = np.where(paired, H.blend(level.name[keep], level.name[mate], 13), level.name[keep])
    text = level.text[keep]
    inside = (keep + 1 < len(level.name)) & (level.text[mate] == text)
    hi = np.where(paired, level.hi[mate], level.hi[keep])
    waits = ~paired & ~right[keep]
    hi = np.where(waits, np.where(inside, level.hi[mate], edge[text + 1] + 1), hi)
    prior = keep - 1
    has = (prior >= 0) & (level.text[prior] == text)
    lo = np.where(right[keep], np.where(has, level.lo[prior], edge[text] - 1), level.lo[keep])
    return Level(name, lo, hi, text)


def levels(code: np.ndarray, edge: np.ndarray, rounds: int) -> list[Level]:
    at = np.arange(len(code))
    out = [Level(code, at, at + 1, np.repeat(np.arange(len(edge) - 1), np.diff(edge)))]
    for r in range(rounds):
        level = out[-1]
        if r in RUN_ROUNDS:
            level = name_runs(level, edge)
        out.append(name_pairs(level, edge, r + 1))
    return out


def _smallest(level: Level, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each range of symbols the one with the smallest hashed name, of equals the last."""
    bits = U(32)  # more symbols than a text of 4 GB can have
    mask = (U(1) << bits) - U(1)
    order = (H.mix(level.name + U(101)) & ~mask) | (mask - np.arange(len(level.name), dtype=np.uint64))
    table, size = [order], 1
    while 2 * size <= int((end - begin).max(initial=1)):
        last = table[-1]
        table.append(np.minimum(last[: max(0, len(last) - size)], last[size:]))
        size *= 2
    span = np.frexp((end - begin).astype(np.float64))[1] - 1
    best = np.empty(len(begin), np.uint64)
    for k in np.unique(span):
        here = span == k
        best[here] = np.minimum(table[k][begin[here]], table[k][end[here] - (1 << int(k))])
    return (mask - (best & mask)).astype(np.int64)


def file_windows(code: np.ndarray, edge: np.ndarray, width: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows under one symbol: text, first window, count, key, and a hash of all their words."""
    size = np.diff(edge)
    starts = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(edge[:-1], edge[1:]) if b - a >= width] or [np.empty(0, np.int64)])
    none = np.empty(0, np.int64)
    if len(starts) == 0:
        return {"text": none, "lo": none, "n": none, "key": none.astype(np.uint64), "ctx": none.astype(np.uint64)}
    lo_of, hi_of = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    name_of, place_of = np.empty(len(starts), np.uint64), np.empty(len(starts), np.int64)
    open_ = np.arange(len(starts))
    base = 0
    for level in reversed(levels(code, edge, rounds)):
        s = starts[open_]
        begin, end = np.searchsorted(level.lo, s), np.searchsorted(level.hi, s + width, "right")
        hit = begin < end
        won = open_[hit]
        if len(won):
            symbol = _smallest(level, begin[hit], end[hit])
            lo_of[won], hi_of[won], name_of[won] = level.lo[symbol], level.hi[symbol], level.name[symbol]
            place_of[won] = base + symbol
            open_ = open_[~hit]
        base += len(level.name)
        if len(open_) == 0:
            break
    text = np.repeat(np.arange(len(size)), np.maximum(size - width + 1, 0))
    head = np.flatnonzero(np.concatenate([[True], (place_of[1:] != place_of[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.concatenate([head, [len(starts)]]))
    table = H.doubled(code, width)
    key = H.blend(H.runs(table, lo_of[head], hi_of[head], 5), name_of[head], 5)
    first, last = starts[head], starts[head + n - 1]
    ctx = H.blend(H.runs(table, first, first + width), H.runs(table, last, last + width), 17)
    return {"text": text[head], "lo": first - edge[text[head]], "n": n, "key": key, "ctx": H.blend(ctx, n.astype(np.uint64), 19)}


def filed(docs: DataFrame, width: int, rounds: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in H.parts(batch, BYTES_AT_ONCE):
                code, edge = H.words(part.column("text"))
                out = file_windows(code, edge, width, rounds)
                at = pa.array(out["text"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row").take(at),
                        part.column("doc_id").take(at),
                        pa.array(out["lo"].astype(np.int32)),
                        pa.array(out["n"].astype(np.int32)),
                        H.signed(out["key"]),
                        H.signed(out["ctx"]),
                    ],
                    names=["row", "doc_id", "lo", "n", "key", "ctx"],
                )

    return docs.mapInArrow(run, FILED)


def _window_hashes(width: int):
    """Of each passage ``(key, ctx, doc_id, most, lo, n)`` of a text one row per window with a hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in H.parts(batch, BYTES_AT_ONCE):
                code, edge = H.words(part.column("text"))
                table = H.doubled(code, width)
                spans = part.column("asked").flatten()
                owner = part.column("asked").value_parent_indices().to_numpy()
                lo = spans.field("lo").to_numpy().astype(np.int64) + edge[owner]
                n = spans.field("n").to_numpy().astype(np.int64)
                of = np.repeat(np.arange(len(n)), n)
                off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                begin = lo[of] + off
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [
                        spans.field("key").take(at),
                        spans.field("ctx").take(at),
                        spans.field("doc_id").take(at),
                        spans.field("most").take(at),
                        pa.array(off.astype(np.int32)),
                        H.signed(H.runs(table, begin, begin + width, 23)),
                    ],
                    names=["key", "ctx", "doc_id", "most", "off", "window"],
                )

    return run


def _kept(width: int):
    """Drops the words that the windows in ``spans`` cover, and digests the others."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                buf = np.frombuffer(text.encode() + b"\n", np.uint8)
                begin, end = H.word_spans(buf)
                step = np.zeros(len(begin) + 1, np.int64)
                for s in spans or ():
                    step[s["lo"]] += 1
                    step[s["lo"] + s["n"] - 1 + width] -= 1
                gone = np.cumsum(step[:-1]) > 0
                whole, digest = buf.tobytes(), hashlib.sha256()
                if len(begin):
                    digest.update(b" ".join(whole[a:b] for a, b in zip(begin[~gone].tolist(), end[~gone].tolist())))
                rows.append((doc_id, len(begin), int(gone.sum()), digest.hexdigest()))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("doc_id", "n_words", "n_removed", "kept_sha256"), r)) for r in rows],
                pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]),
            )

    return run


def remove_repeats(docs: DataFrame, width: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per document.

    Removes each word that a window of ``width`` words covers whose word sequence also starts in a
    document with a smaller id; windows are judged on the input. A null text has no words. A null
    id counts as smaller than all others; rows with equal ids are one document, and none of them
    loses words to another. Repeated rows get equal results each. Shorter texts than a window
    lose nothing. Other columns are ignored.
    """
    docs = texts_of(docs)
    rank = F.coalesce("doc_id", F.lit(-(2**63)))
    places = scratch(filed(docs.withColumn("doc_id", rank), width, rounds), "filed")
    meets = (
        places.groupBy("key")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
        .where("least < most")
        .select("key", "least", (F.col("c0") < F.col("c1")).alias("mixed"))
    )
    shared = scratch(places.join(meets, "key").where("doc_id > least or mixed"), "shared")

    # One passage of each kind stands for all: that of the smallest id.
    passages = (
        shared.where("mixed")
        .groupBy("key", "ctx")
        .agg(F.min(F.struct("doc_id", "row", "lo", "n")).alias("p"), F.max("doc_id").alias("most"))
    )
    asked = passages.select("p.row", F.struct("key", "ctx", "p.doc_id", "most", "p.lo", "p.n").alias("a"))
    per_row = (
        asked.select("row", "a")
        .unionByName(shared.select("row", F.lit(None).cast(asked.schema["a"].dataType).alias("a")).distinct())
        .groupBy("row")
        .agg(F.collect_list("a").alias("asked"))
    )
    flat = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    touched = F.col("asked").isNotNull()
    texts = scratch(
        docs.join(per_row.hint("shuffle_hash"), "row", "left").select(
            "row",
            "doc_id",
            "asked",
            F.when(touched, F.col("text")).alias("text"),
            F.when(~touched, F.when(flat == "", 0).otherwise(F.regexp_count(flat, F.lit(" ")) + 1)).cast("long").alias("n_words"),
            F.when(~touched, F.sha2(flat, 256)).alias("kept_sha256"),
        ),
        "texts",
    )

    windows = scratch(
        texts.where("size(asked) > 0").select("text", "asked").mapInArrow(_window_hashes(width), WINDOWS), "windows"
    )
    earliest = windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("most").alias("most")).where("least < most")
    found = (
        windows.join(earliest.select("window", "least"), "window")
        .groupBy("key", "ctx")
        .agg(F.collect_set(F.struct("off", "least")).alias("offs"))
    )
    apart = (
        shared.where("mixed")
        .join(found, ["key", "ctx"])
        .select("row", "lo", F.explode(F.filter("offs", lambda x: x["least"] < F.col("doc_id"))).alias("x"))
        .select("row", (F.col("lo") + F.col("x.off")).alias("lo"), F.lit(1).alias("n"))
    )
    whole = shared.where("not mixed").select("row", "lo", "n")
    spans = whole.unionByName(apart).groupBy("row").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))
    cut = (
        texts.where("asked is not null")
        .join(spans.hint("shuffle_hash"), "row", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_kept(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    )
    rest = texts.where("asked is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return rest.unionByName(cut)
