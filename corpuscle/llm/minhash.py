"""Near duplicates by one-permutation MinHash with optimal densification.

A set of word shingles is hashed once; each of the bins keeps its smallest hash, and an empty bin
takes the value of a filled one that a hash of the bin picks. Bands of bins are bucket keys.
Documents with equal sets form a class first. In each bucket the first class is linked to all
others, a star; it is the one with the fewest shingles that no other has, so it links most. Members that no verified link has joined are compared in further rounds, whose
centres grow in number. So every pair that shares a bucket is either in one component, or was
verified on the full sets, or has a member with too few shingles that occur in any other class
that shares a bucket, or cannot have enough shingles in common by the counts of its sketch, which rules out the link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm import hashing as H
from corpuscle.llm.common import scratch, texts_of
from corpuscle.llm.components import components

WORDS = 5
ROWS, BANDS = 4, 32
STEP = 81  # each round has this many times the centres of all before
BYTES_AT_ONCE = 1 << 20
CELLS = 128  # of a sketch, one byte each
U = np.uint64
SIGNED = "row long, doc_id long, n_shingles long, class long, bands array<long>"


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text; a shorter text is one shingle, one without words none."""
    code, edge = H.words(texts, lower=True)
    table = H.doubled(code, words)
    out = []
    at = np.arange(max(0, len(code) - words + 1))
    every = H.runs(table, at, at + words)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(every[a : b - words + 1]))
        elif b > a:
            out.append(H.runs(table, np.array([a]), np.array([b])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of bin values per set; sets must not be empty."""
    low = (np.arange(bins, dtype=np.uint64) * U(2**64 // bins))
    out, filled = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for k, s in enumerate(sets):
        first = np.searchsorted(s, low)
        after = np.append(first[1:], len(s))
        has = first < after
        filled[k] = has
        out[k, has] = s[first[has]]
    row, col = np.nonzero(~filled)
    attempt = 0
    while len(row):
        attempt += 1
        pick = (H.mix(col.astype(np.uint64) * U(H.BASE) + U(attempt)) % U(bins)).astype(np.int64)
        hit = filled[row, pick]
        out[row[hit], col[hit]] = out[row[hit], pick[hit]]
        row, col = row[~hit], col[~hit]
    return out


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in H.parts(batch, BYTES_AT_ONCE):
                sets = shingle_sets(part.column("text"))
                size = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(size)
                code = signatures([sets[k] for k in some], bands * rows).reshape(len(some), bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + U(41), code.shape[:2])
                for r in range(rows):
                    key = H.blend(key, code[:, :, r], 43)
                edge = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                of = np.array([H.mix(H.mix(s).sum(keepdims=True) + U(len(s)))[0] if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        pa.array(size),
                        pa.array(of.view(np.int64), mask=size == 0),
                        pa.ListArray.from_arrays(pa.array(edge), H.signed(key.reshape(-1))),
                    ],
                    names=["row", "doc_id", "n_shingles", "class", "bands"],
                )

    return run


def _sketch(items: np.ndarray) -> np.ndarray | None:
    """How many shingles fall into each cell; none where a count is beyond a byte's range."""
    counts = np.bincount((items >> U(20)).astype(np.int64) & (CELLS - 1), minlength=CELLS)
    return counts.astype(np.int8) if counts.max() < 128 else None


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in H.parts(batch, BYTES_AT_ONCE):
            sets = shingle_sets(part.column("text"))
            held = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([_sketch(s) for s in sets], pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays([part.column("class"), *held], names=["class", "shingles", "sketch"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            items = np.frombuffer(batch.column("shingles")[row].as_buffer(), np.int64)
            of = np.full(len(items), batch.column("class")[row].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(of)], names=["shingle", "class"])


def _linkable(sets: DataFrame, percent: int) -> DataFrame:
    """``class, shingles, sketch, size, shared`` of the sets that can have a link.

    ``shared`` counts the shingles that another set has, too; no other is in an intersection.
    A text that only shares a passage with others is mostly its own, and is ruled out
    without being compared. Shingles are counted by partial minima and maxima.
    """
    owners = sets.mapInArrow(_shingles, "shingle long, class long").groupBy("shingle").agg(F.min("class").alias("class"), F.max("class").alias("z"))
    own = owners.where("class = z").groupBy("class").agg(F.count(F.lit(1)).alias("own"))
    size = (F.length("shingles") / 8).cast("long")
    counted = sets.join(own, "class", "left").select("class", "shingles", "sketch", size.alias("size"), (size - F.coalesce("own", F.lit(0))).alias("shared"))
    return counted.where(100 * F.col("shared") >= percent * F.col("size"))


def _possible(percent: int) -> Column:
    """Whether ``size, shared`` and ``size_a, shared_a`` leave room for a link."""
    both = F.least("shared", "shared_a")
    return (100 + percent) * both >= percent * (F.col("size") + F.col("size_a"))


def _overlapping(percent: int) -> Column:
    """Whether the sketches leave room for a link: cell by cell no more shingles are common than the smaller count."""
    least = F.zip_with("sketch", "sketch_a", lambda x, y: F.least(x, y))
    both = F.aggregate(least, F.lit(0), lambda total, x: total + x)
    room = (100 + percent) * both >= percent * (F.col("size") + F.col("size_a"))
    return F.when(F.col("sketch").isNull() | F.col("sketch_a").isNull(), True).otherwise(room)


def _linked(percent: int):
    """Keeps the pairs whose sets are alike: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)) else 0
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs ``a, b``; sets travel to the member first, then to its centre."""
    of_b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))
    of_a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"))
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long")


def _first_shared(keys: Column, others: Column) -> Column:
    """The first bucket that two classes share: the one in which they meet, so that no pair is made twice."""
    return F.filter(F.zip_with(keys, others, lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())[0]


def _starred(spread: DataFrame, *by: str) -> DataFrame:
    """The rows ``bucket, class, ...`` of buckets with several classes, and ``a``, the bucket's first class."""
    first = F.struct(*by, "class")
    centres = spread.groupBy("bucket").agg(F.min(first).alias("a"), F.max(first).alias("z")).where("a < z").select("bucket", "a.class")
    return spread.join(centres.withColumnRenamed("class", "a"), "bucket")


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``row, doc_id, n_shingles, component_id, kept, first`` per document.

    Texts are lower-cased (A-Z) and cut at white space into sets of five-word shingles. Documents
    whose sets have a likeness of ``percent`` or more are linked, confirmed on the full sets; with
    the default bands a pair at 75 % is missed once in 190,000. ``component_id`` is the smallest id
    that links reach; ``kept`` says whether it is the document's own; ``first`` marks one row of each
    component, the first by id and then by hash, or several if they are equal. A null or blank text
    has an empty set and no link. A null id counts as the smallest; equal rows get equal results.
    """
    docs = texts_of(docs)
    signed = scratch(docs.mapInArrow(_signed(bands, rows), SIGNED), "signatures")
    rank = F.coalesce("doc_id", F.lit(-(2**63)))
    classes = scratch(
        signed.where("class is not null")
        .groupBy("class")
        .agg(F.min(F.struct(rank.alias("least"), "row")).alias("p"), F.first("bands").alias("bands"))
        .select("class", "p.least", "p.row", "bands"),
        "classes",
    )
    spread = classes.select(F.explode("bands").alias("bucket"), "class")
    met = scratch(_starred(spread).select("class").distinct().join(classes.select("class", "row"), "class"), "met")
    sets = scratch(docs.select("row", "text").join(met.hint("shuffle_hash"), "row").dropDuplicates(["class"]).mapInArrow(_sets, "class long, shingles binary, sketch array<byte>"), "sets")
    sets = scratch(_linkable(sets, percent), "linkable")
    counted = sets.select("class", "size", "shared")
    own = F.col("size") - F.col("shared")
    buckets = scratch(_starred(spread.join(counted.withColumn("own", own), "class"), "own"), "buckets")
    keyed = sets.select("class", "size", "shared", "sketch").join(classes.select("class", F.col("bands").alias("keys")), "class")
    of_centre = counted.select(F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("shared").alias("shared_a"))

    spokes = buckets.where("class != a").select("a", "class", "own", "size", "shared").distinct()
    spokes = scratch(spokes.join(of_centre, "a").where(_possible(percent)).select("a", F.col("class").alias("b")), "pairs")
    links = scratch(_verified(spokes, sets, percent), "links")
    labels = components(links)
    centre, ranked = 1, None
    while True:
        here = (buckets.select("bucket", "class", "own") if ranked is None else ranked).drop("label").join(labels.withColumnRenamed("node", "class"), "class", "left")
        here = here.withColumn("label", F.coalesce("label", "class"))
        mixed = here.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("held")).where("x < y and held > 2")
        here = here.join(mixed.select("bucket"), "bucket", "left_semi")
        if ranked is None:
            here = here.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy("own", "class"))).drop("own").join(keyed, "class")
        ranked = scratch(here, "open")
        last = ranked.agg(F.max("nth")).first()[0] or 0
        if last <= centre:
            break
        heads = ranked.where((F.col("nth") > centre) & (F.col("nth") <= STEP * centre)).select(
            "bucket", *[F.col(c).alias(f"{c}_a") for c in ("class", "label", "nth", "size", "shared", "sketch", "keys")]
        )
        here = _possible(percent) & F.expr("nth > nth_a and label <> label_a") & (F.col("bucket") == _first_shared(F.col("keys"), F.col("keys_a"))) & _overlapping(percent)
        fresh = ranked.join(heads, "bucket").where(here).select(F.col("class_a").alias("a"), F.col("class").alias("b"))
        pairs = scratch(fresh.join(spokes, ["a", "b"], "left_anti"), "pairs")
        more = scratch(_verified(pairs, sets, percent), "links")
        centre *= STEP
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)

    first = F.struct("least", "row")
    of_label = labels.withColumnRenamed("node", "class")
    whole = classes.join(of_label, "class").groupBy("label").agg(F.min(first).alias("whole"))
    chosen = (
        classes.select("class", first.alias("own"))
        .join(of_label, "class", "left")
        .join(whole, "label", "left")
        .select("class", F.coalesce("whole", "own").alias("head"))
    )
    found = signed.drop("bands").join(chosen, "class", "left")
    none = F.col("class").isNull()
    component = F.when(none, F.col("doc_id")).when(F.col("head.least") == -(2**63), None).otherwise(F.col("head.least"))
    return found.select(
        "row", "doc_id", "n_shingles", component.alias("component_id"), (none | (F.col("row") == F.col("head.row"))).alias("first")
    ).select("row", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "first")


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents, with all their columns, of which each component keeps one and equal rows keep one."""
    marked = docs.withColumn("_row_of_text", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    firsts = near_duplicates(docs, percent).where("first").select(F.col("row").alias("_row_of_text")).distinct()
    return marked.join(firsts.hint("shuffle_hash"), "_row_of_text").dropDuplicates(["_row_of_text"]).drop("_row_of_text")
