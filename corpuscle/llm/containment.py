"""Benchmark decontamination by containment search, in DataFrame functions.

Items are partitioned by size. In a partition an item is known by the smallest hashes of its
shingles, so many that a document which lacks all of them cannot reach the containment. Documents
that hold one are candidates for the item, and are verified on all of the item's shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import scratch, texts_of

WORDS = 5
SMALL_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words at ASCII white space, A-Z lower-cased."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(word: Column, size: int = WORDS) -> Column:
    """Hashes of all runs of ``size`` words; of fewer words one hash of all, of none no hash.

    ``word`` must be a column of its own, as an expression would be evaluated anew for each run.
    """
    n = F.size(word)
    many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(size)]))
    return F.when(n >= size, many).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", word)))).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame, percent: int) -> DataFrame:
    """``item_id, shingle, size, known``: the distinct shingles of each item, and whether they are among those it is known by."""
    sets = (
        items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .where("item_id is not null")
        .withColumn("word", words(F.col("text")))
        .select("item_id", F.array_sort(F.array_distinct(shingles(F.col("word")))).alias("set"))
        .where("size(set) > 0")
        .dropDuplicates(["item_id", "set"])
        .groupBy("item_id")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("set")))).alias("set"))
        .withColumn("size", F.size("set"))
    )
    # The largest size of the partition sets how many of its hashes an item is known by.
    most = F.pow(F.lit(2.0), F.floor(F.log2("size")) + 1).cast("int") - 1
    known = F.floor(most * (100 - percent) / 100).cast("int") + 1
    return sets.withColumn("known", known).select("item_id", "size", "known", F.posexplode("set").alias("nth", "shingle")).select(
        "item_id", "shingle", "size", (F.col("nth") < F.col("known")).alias("known")
    )


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """``row, doc_id, item_id, shared, containment`` for each document that holds ``percent`` of an item's shingles.

    Texts are lower-cased (A-Z) and cut at white space into distinct five-word shingles; of fewer
    words the whole sequence is one. Rows of equal item ids make one item. Null or
    blank texts match nothing, items without id are left out, documents without id are compared as
    any other. Equal documents get equal rows each.
    """
    docs = texts_of(docs)
    known = scratch(item_shingles(items, percent), "items")
    universe = known.select("shingle").distinct()
    if known.count() <= SMALL_ROWS:
        universe = F.broadcast(universe)
    hits = scratch(
        docs.select("row", "doc_id", words(F.col("text")).alias("word"))
        .select("row", "doc_id", F.explode(shingles(F.col("word"))).alias("shingle"))
        .join(universe, "shingle", "left_semi")
        .distinct(),
        "hits",
    )
    candidates = hits.join(known.where("known"), "shingle").select("row", "doc_id", "item_id").distinct()
    found = (
        hits.join(known.drop("known"), "shingle")
        .join(candidates.select("row", "item_id"), ["row", "item_id"], "left_semi")
        .groupBy("row", "doc_id", "item_id", "size")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(F.col("shared") * 100 >= F.col("size") * percent)
    )
    return found.select("row", "doc_id", "item_id", "shared", (F.col("shared") / F.col("size")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    marked = docs.withColumn("_row_of_text", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    bad = contaminated(docs, items, percent).select(F.col("row").alias("_row_of_text")).distinct()
    return marked.join(bad, "_row_of_text", "left_anti").drop("_row_of_text")
