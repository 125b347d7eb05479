"""Repeated byte strings, found by suffix arrays over shards.

Windows of ``width`` bytes are filed by the smallest hashed gram inside them, and by the longest
bytes that all windows filed there share. Equal windows are filed under one key, so only passages
whose key occurs twice go on. These are dealt out by key into shards of bounded size. A shard sorts
its suffixes by refining groups with doubled prefixes (Larsson and Sadakane), takes common prefixes
with neighbours in Kasai's order, one lane per passage, and so finds the windows that occur twice.
The passages of a frequent key fill several shards, whose distinct windows are then merged: each
shard hands on sorted runs of window hashes by hash range, and these are looked up in one another by
binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import hashing as H
from corpuscle.llm.common import scratch, texts_of

GRAM = 32
PIECE = 1 << 19
SHARD_BYTES = 2 << 20
MERGE_ROWS = 500_000
RUN_ROWS = 1024
U = np.uint64
FILED = "row long, lo int, n int, key long, ctx long"
PASSAGE = "key long, ctx long, salt int, bytes binary"
PLACE = "window: bigint, key: bigint, ctx: bigint, off: int"
FOUND = f"key long, ctx long, off int, n int, bucket int, run array<struct<{PLACE}>>"


def _window_minimum(order: np.ndarray, width: int) -> np.ndarray:
    size, best = 1, order
    while 2 * size <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    return best if size == width else np.minimum(best[: len(best) - (width - size)], best[width - size :])


def file_windows(buf: np.ndarray, width: int, valid: np.ndarray):
    """Runs of neighbouring windows with one key: first window, count, key, hash of all their bytes.

    ``valid`` marks where windows may start; ``buf`` is below a megabyte.
    """
    gram = min(GRAM, width)
    count = len(buf) - width + 1
    none = np.empty(0, np.int64)
    if count <= 0 or not valid.any():
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(H.BYTES[buf] * H.powers(len(buf)), out=total[1:])
    inverse = H.powers(len(buf) + 1, True)

    def code(begin, size):
        return H.mix((total[begin + size] - total[begin]) * inverse[begin])

    grams = H.mix((total[gram:] - total[:-gram]) * inverse[: len(buf) - gram + 1])
    mask = U((1 << 20) - 1)
    order = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    anchor = (mask - (_window_minimum(order, width - gram + 1) & mask)).astype(np.int64)
    start = np.flatnonzero(valid[:count])
    anchor = anchor[start]
    half = (width - gram) // 2
    late = anchor - start > half
    place = 2 * anchor + late
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(start) != 1)]))
    n = np.diff(np.concatenate([head, [len(start)]]))
    a, late, first = anchor[head], late[head], start[head]
    # All windows of a run hold these bytes: left of the anchor and the anchor, or the anchor and right of it.
    key = H.blend(code(np.where(late, a - half, a), np.where(late, half + gram, width - half)), late.astype(np.uint64), 5)
    ctx = H.blend(code(first, width), code(first + n - 1, width), 17)
    return first, n, key, H.blend(ctx, n.astype(np.uint64), 19)


def _pieces(texts: pa.Array, width: int):
    """Buffers, where windows may start in each, the owner of each byte, and its offset in the owner's text."""
    buf, start = H.joined(texts)
    step = np.zeros(len(buf) + 1, np.int8)
    long = np.flatnonzero(np.diff(start) - 1 >= width)
    step[start[long]] += 1
    step[start[long + 1] - width] -= 1
    valid = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    for at in range(0, len(buf), PIECE):
        inside = valid[at : at + PIECE]
        if inside.any():
            yield at, buf[at : at + PIECE + width - 1], inside, start


def filed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in H.parts(batch, PIECE - (PIECE >> 3)):
                for at, buf, inside, start in _pieces(part.column("text"), width):
                    first, n, key, ctx = file_windows(buf, width, inside)
                    owner = np.searchsorted(start, first + at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("row").take(pa.array(owner)),
                            pa.array((first + at - start[owner]).astype(np.int32)),
                            pa.array(n.astype(np.int32)),
                            H.signed(key),
                            H.signed(ctx),
                        ],
                        names=["row", "lo", "n", "key", "ctx"],
                    )

    return docs.mapInArrow(run, FILED)


def suffix_order(buf: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first ``depth`` bytes or more, ties by position; and the place of each."""
    n = len(buf)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = buf.astype(np.uint64) + U(1)
    packed = wide[:n].copy()
    for k in range(1, 7):
        packed = (packed << U(9)) | wide[k : n + k]
    order = np.argsort(packed)
    rank = np.full(n + 1, 0, np.int64)
    seen, slots = packed[order], np.arange(n)

    def regroup(slots, order, seen):
        """Gives each group the place of its first member, and keeps the slots of groups with several."""
        new = np.concatenate([[True], seen[1:] != seen[:-1]])
        rank[order] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] + 1
        return slots[~(new & np.concatenate([new[1:], [True]]))]

    slots = regroup(slots, order, seen)
    size = 7
    while len(slots) and size < depth:
        here = order[slots]
        pair = (rank[here].astype(np.uint64) << U(32)) | rank[np.minimum(here + size, n)].astype(np.uint64)
        by = np.argsort(pair)
        order[slots] = here[by]
        slots = regroup(slots, order[slots], pair[by])
        size *= 2
    if len(slots):
        here = order[slots]
        order[slots] = here[np.lexsort((here, rank[here]))]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(buf: np.ndarray, order, place, begin, size, most: int) -> np.ndarray:
    """For each position the bytes, up to ``most``, that its suffix shares with the one before it in the order.

    Kasai: a position shares at least one byte less than the position before it. All lanes, from
    ``begin`` over ``size`` positions, advance together.
    """
    n = len(buf)
    wide = np.zeros(n + most + 16, np.uint64)
    wide[:n] = buf
    eight = wide[: n + most + 8].copy()
    for k in range(1, 8):
        eight = (eight << U(8)) | wide[k : n + most + 8 + k]
    before = np.where(place > 0, order[place - 1], -1)
    out = np.zeros(n, np.int32)
    by = np.argsort(-size, kind="stable")
    begin, size = begin[by], size[by]
    got = np.zeros(len(begin), np.int64)
    for p in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-size, -p, "left"))
        i = begin[:live] + p
        j = before[i]
        h = np.where(j < 0, 0, np.maximum(got[:live] - 1, 0))
        more = np.flatnonzero((j >= 0) & (h < most))
        while len(more):
            unlike = eight[i[more] + h[more]] ^ eight[j[more] + h[more]]
            alike = np.zeros(len(more), np.int64)
            for k in range(8):
                alike += (unlike >> U(8 * k)) == 0
            h[more] += alike
            more = more[(alike == 8) & (h[more] < most)]
        got[:live] = h
        out[i] = np.minimum(h, most)
    return out


def repeated_windows(passages: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows in the passages: passage, offset, whether it occurs twice, and whether an equal one came before it in order."""
    end = b"\xff"  # in no UTF-8 text, so that nothing equal reaches over an end
    buf = np.frombuffer(end.join(passages) + end, np.uint8)
    size = np.array([len(p) for p in passages])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    # To the last byte: Kasai's order fails where suffixes that agree beyond some depth are left as they come.
    order, place = suffix_order(buf, len(buf))
    count = size - width + 1
    share = common_prefixes(buf, order, place, begin, size, width)
    same = share >= width
    of = np.repeat(np.arange(len(passages)), count)
    off = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[of] + off
    inside = np.zeros(len(buf), bool)
    inside[at] = True
    with_last = same & inside & inside[np.where(place > 0, order[place - 1], 0)] & (place > 0)
    follows = np.zeros(len(buf) + 1, bool)
    follows[place] = with_last
    return of, off, with_last[at] | follows[place[at] + 1], with_last[at]


def _sorted_runs(window: np.ndarray, key, ctx, off, buckets: int) -> tuple[np.ndarray, pa.Array]:
    """The windows of a shard by bucket, each bucket's in order, in runs of ``RUN_ROWS`` at most: buckets and runs."""
    bucket = (H.mix(window) % U(buckets)).astype(np.int64)
    by = np.lexsort((window, bucket))
    bucket = bucket[by]
    new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    nth = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    head = np.flatnonzero(nth % RUN_ROWS == 0)
    place = pa.StructArray.from_arrays(
        [H.signed(window[by]), pa.array(key[by]), pa.array(ctx[by]), pa.array(off[by].astype(np.int32))], names=["window", "key", "ctx", "off"]
    )
    return bucket[head], pa.ListArray.from_arrays(pa.array(np.append(head, len(by)).astype(np.int32)), place)


def _search_shard(width: int, shard_bytes: int, buckets: int):
    """Of passages sorted by key and salt the runs of windows that occur twice; of salted keys also all distinct windows, in sorted runs."""

    def flush(rows) -> pa.RecordBatch:
        key, ctx, salt = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        of, off, twice, again = repeated_windows([r[3] for r in rows], width)
        here = np.flatnonzero(twice)
        new = np.concatenate([[True], (np.diff(here) != 1) | (np.diff(of[here]) != 0)]) if len(here) else np.empty(0, bool)
        head = np.flatnonzero(new)
        n = np.diff(np.concatenate([head, [len(here)]]))
        head = here[head]
        cols = [pa.array(key[of[head]]), pa.array(ctx[of[head]]), pa.array(off[head].astype(np.int32)), pa.array(n.astype(np.int32))]
        single = np.flatnonzero((salt[of] >= 0) & ~again)
        bucket, runs = np.empty(0, np.int64), None
        if len(single):
            buf = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
            begin = np.cumsum([0] + [len(r[3]) for r in rows])[of[single]] + off[single]
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(H.BYTES[buf] * H.powers(len(buf)), out=total[1:])
            window = H.mix((total[begin + width] - total[begin]) * H.powers(len(buf) + 1, True)[begin])
            bucket, runs = _sorted_runs(window, key[of[single]], ctx[of[single]], off[single], buckets)
        more = len(bucket)
        kind = pa.list_(pa.struct([("window", pa.int64()), ("key", pa.int64()), ("ctx", pa.int64()), ("off", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([c, pa.nulls(more, c.type)]) for c in cols]
            + [
                pa.concat_arrays([pa.nulls(len(head), pa.int32()), pa.array(bucket.astype(np.int32))]),
                pa.concat_arrays([pa.nulls(len(head), kind)] + ([runs.cast(kind)] if more else [])),
            ],
            names=["key", "ctx", "off", "n", "bucket", "run"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "ctx", "salt", "bytes")), strict=True):
                if held >= shard_bytes and r[0::2][:2] != last:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[3])
                last = r[0::2][:2]
        if rows:
            yield flush(rows)

    return run


def _merge_shards(table: pa.Table) -> pa.Table:
    """Windows that occur in several shards: each shard has a window once, and its sorted runs are searched in the run of all."""
    places = pa.concat_arrays([chunk.flatten() for chunk in table.column("run").chunks])
    window = places.field("window").to_numpy()
    merged = np.sort(window, kind="stable")
    hit = np.searchsorted(merged, window, "right") - np.searchsorted(merged, window) > 1
    return pa.Table.from_arrays([places.field(c) for c in ("key", "ctx", "off")], names=["key", "ctx", "off"]).filter(pa.array(hit))


def _passages(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, asked in zip(batch.column("text"), batch.column("asked").to_pylist(), strict=True):
                whole = text.as_py().encode()
                rows += [(a["key"], a["ctx"], a["salt"], whole[a["lo"] : a["lo"] + a["n"] - 1 + width]) for a in asked]
            cols = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "ctx", "salt", "bytes"])

    return run


def _kept(width: int):
    """Drops the bytes that the windows in ``spans`` cover, and digests the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                whole = text.as_py().encode()
                digest, at, removed, runs, until = hashlib.sha256(), 0, 0, 0, -1
                for s in sorted(spans or (), key=lambda s: s["lo"]):
                    lo, hi = s["lo"], s["lo"] + s["n"] - 1 + width
                    if lo > until:
                        digest.update(whole[at:lo])
                        runs += 1
                        removed += hi - lo
                    else:
                        removed += max(0, hi - until)
                    at = until = max(until, hi)
                digest.update(whole[at:])
                rows.append({"doc_id": doc_id, "n_bytes": len(whole), "n_removed": removed, "n_spans": runs, "kept_sha256": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def remove_repeats(docs: DataFrame, width: int = 400, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per document.

    Removes each byte of the UTF-8 text that a string of ``width`` bytes covers which also starts
    anywhere else, in the same document or another; strings are judged on the input. A null text is
    empty; texts shorter than ``width`` lose nothing. Ids play no part and may be null or repeated:
    of two equal rows, each repeats the other. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = texts_of(docs)
    places = scratch(filed(docs, width), "filed")
    meets = (
        places.groupBy("key")
        .agg(F.count(F.lit(1)).alias("count"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
        .where("count > 1")
        .select("key", (F.col("c0") < F.col("c1")).alias("mixed"))
    )
    shared = scratch(places.join(meets, "key"), "shared")

    # One passage of each kind stands for all of its kind.
    kinds = shared.where("mixed").groupBy("key", "ctx").agg(F.min(F.struct("row", "lo", "n")).alias("p"), F.count(F.lit(1)).alias("count"))
    passages = scratch(kinds.select("key", "ctx", "p.row", "p.lo", "p.n", "count"), "passages")
    held = max(1, shard_bytes // (2 * width))
    hot = passages.groupBy("key").count().where(F.col("count") > held).select("key", F.ceil(F.col("count") / held).cast("int").alias("shards"))
    asked = passages.join(hot, "key", "left").select(
        "row",
        F.struct(
            "key",
            "ctx",
            F.coalesce(F.pmod(F.xxhash64("ctx"), F.col("shards")), F.lit(-1)).cast("int").alias("salt"),
            "lo",
            "n",
        ).alias("a"),
    )
    per_row = (
        asked.unionByName(shared.select("row", F.lit(None).cast(asked.schema["a"].dataType).alias("a")).distinct())
        .groupBy("row")
        .agg(F.collect_list("a").alias("asked"))
    )
    touched = F.col("asked").isNotNull()
    texts = scratch(
        docs.join(per_row.hint("shuffle_hash"), "row", "left").select(
            "row",
            "doc_id",
            "asked",
            F.when(touched, F.col("text")).alias("text"),
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.when(~touched, F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"),
        ),
        "texts",
    )
    # Equal rows ask alike, and one of them is enough: a passage must not meet itself.
    bytes_ = texts.where("size(asked) > 0").select("text", "asked").mapInArrow(_passages(width), PASSAGE)
    dealt = bytes_.dropDuplicates(["key", "ctx"]).repartition("key", "salt").sortWithinPartitions("key", "salt")
    split = passages.join(hot, "key", "left_semi").agg(F.sum("n").alias("windows")).first()["windows"] or 0
    buckets = 1 + split // MERGE_ROWS
    found = scratch(dealt.mapInArrow(_search_shard(width, shard_bytes, buckets), FOUND), "found")
    runs = found.where("run is null").select("key", "ctx", "off", "n")
    across = (
        found.where("run is not null")
        .groupBy("bucket")
        .applyInArrow(_merge_shards, "key long, ctx long, off int")
        .select("key", "ctx", "off", F.lit(1).alias("n"))
    )
    several = passages.where("count > 1").select("key", "ctx", F.lit(0).alias("off"), "n")
    by_kind = runs.unionByName(across).unionByName(several)
    apart = shared.where("mixed").select("row", "lo", "key", "ctx").join(by_kind, ["key", "ctx"])
    spans = (
        shared.where("not mixed")
        .select("row", "lo", "n")
        .unionByName(apart.select("row", (F.col("lo") + F.col("off")).alias("lo"), "n"))
        .groupBy("row")
        .agg(F.collect_set(F.struct("lo", "n")).alias("spans"))
    )
    cut = (
        texts.where("asked is not null")
        .join(spans.hint("shuffle_hash"), "row", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_kept(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
    rest = texts.where("asked is null").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256"
    )
    return rest.unionByName(cut)
