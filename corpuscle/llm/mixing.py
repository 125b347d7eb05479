"""Mixing sources to target weights.

Documents get hash-random keys. The first digits of the key deal them into slots, which are in key
order, so sums by source and slot give each slot its start, and a running sum inside the slot the
words before each document. No task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import WORD, texts_of

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
DIGITS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``src, source_size, target`` from ``src, source, source_size``.

    Sources by code point, null last, take the weights in turn and share ``share`` times all sizes.
    A target stops at ``most`` times its source's size, the excess goes to the others by weight:
    sources are full in order of their size per weight, up to the first that the rest would not fill.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    filling = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), "source")
    total = sizes.agg(F.sum("source_size").alias("all"))
    level = F.lit(share) * F.col("all") - (F.sum("room").over(filling) - F.col("room"))
    rest = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    order = (
        sizes.withColumn("room", most * F.col("source_size"))
        .withColumn("weight", weight)
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("nth", F.row_number().over(filling))
        .withColumn("level", level / rest)
    )
    first = order.where(F.col("level") <= F.col("room") / F.col("weight")).agg(F.min("nth").alias("first"), F.min_by("level", "nth").alias("fill"))
    full = F.col("nth") < F.coalesce("first", F.lit(2**31 - 1))
    return order.crossJoin(F.broadcast(first)).select(  # one row
        "src", "source_size", F.when(full, F.col("room").cast("double")).otherwise(F.col("fill") * F.col("weight")).alias("target")
    )


def _named(source: Column) -> Column:
    """A name for each source, the null one too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``row, src, doc_id, size, source_size, target, taken`` per document.

    ``size`` counts words (null text: 0); ``taken`` is how many words the mix takes, whole epochs
    first, then documents in key order up to the source's budget, the last in part. Sources without words
    have the target 0. Null sources are one source, null ids are ids of their own; rows that are equal
    are taken one after the other.
    """
    sized = texts_of(docs, F.col("source").cast("string").alias("source")).select(
        "row",
        "doc_id",
        "source",
        _named(F.col("source")).alias("src"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("key"),
    )
    sized = sized.withColumn("slot", F.substring("key", 1, DIGITS))
    slots = sized.groupBy("src", "source", "slot").agg(F.sum("size").alias("held"))
    sizes = slots.groupBy("src", "source").agg(F.sum("held").alias("source_size"))
    before = F.sum("held").over(Window.partitionBy("src").orderBy("slot")) - F.col("held")
    starts = slots.select("src", "slot", before.alias("start")).join(targets(sizes), "src")
    inside = F.sum("size").over(Window.partitionBy("src", "slot").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    part = F.greatest(F.lit(0), F.least("size", budget - epochs * F.col("source_size") - F.col("start") - F.col("ahead")))
    return (
        sized.withColumn("ahead", inside - F.col("size"))
        .join(starts, ["src", "slot"])
        .select("row", "src", "doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))
    )


def materialised(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: a document once per epoch, and the one at its source's budget cut to the words taken.

    Columns stay, and ``n_chars``, where there is one, follows a cut. Rows of equal id, text and source share what they
    are taken evenly; equal rows of two sources are taken what each source gives.
    """
    row = F.xxhash64(F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))), _named(F.col("source")))
    taken = mixed(docs, seed).groupBy(F.xxhash64("row", "src").alias("_row_of_text")).agg(F.max("size").alias("_size"), F.floor(F.avg("taken")).cast("long").alias("_taken"))
    whole, rest = F.floor(F.col("_taken") / F.col("_size")), F.col("_taken") % F.col("_size")
    copies = F.sequence(F.lit(1), (whole + F.when(rest > 0, 1).otherwise(0)).cast("int"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), rest.cast("int")), " ")
    out = (
        docs.withColumn("_row_of_text", row)
        .join(taken.where("_taken > 0").hint("shuffle_hash"), "_row_of_text")
        .withColumn("_copy", F.explode(copies))
        .withColumn("_cut", F.col("_copy") > whole)
        .withColumn("text", F.when(F.col("_cut"), cut).otherwise(F.col("text")))
    )
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
