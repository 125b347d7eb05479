"""Document fingerprints by winnowing, in DataFrame functions.

A text is cut into pieces: words, and long words into parts. The hash of each run of ``GRAM`` pieces
is a candidate; of each ``WINDOW`` neighbouring candidates the smallest is chosen, of equals the rightmost,
and kept with its position. Texts that share a run of ``GRAM + WINDOW - 1`` pieces share a choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.common import slot_bounds, slot_of, slots_for, texts_of

PIECE = r"[^\x20\x09-\x0D]{1,6}"
GRAM, WINDOW = 4, 5
LAST = 2**31 - 1


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def candidates(piece: Column, begin: Column) -> Column:
    """From position ``begin`` on: 32 bits of hash above the position counted down, so that the least is the rightmost of equals."""
    at = F.transform(
        F.sequence(begin, F.size(piece) - GRAM),
        lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*[F.get(piece, i + k) for k in range(GRAM)]), 32), 31) + (LAST - i),
    )
    return F.when(F.size(piece) - GRAM >= begin, at).otherwise(F.array().cast("array<bigint>"))


def chosen(value: Column, begin: Column) -> Column:
    """The least candidate of each window from window ``begin`` on."""
    least = F.transform(F.sequence(begin, F.size(value) - WINDOW), lambda j: F.least(*[F.get(value, j + k) for k in range(WINDOW)]))
    return F.when(F.size(value) - WINDOW >= begin, least).otherwise(F.array().cast("array<bigint>"))


def whole_if_short(value: Column, windows: Column, piece: Column) -> Column:
    """Texts of fewer candidates than a window have one choice, of fewer pieces than a run the hash of all pieces."""
    short = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.concat_ws(" ", piece)), 32), 31) + LAST
    return (
        F.when(F.size(value) >= WINDOW, F.array_distinct(windows))
        .when(F.size(value) > 0, F.array(F.array_min(value)))
        .when(F.size(piece) > 0, F.array(short))
        .otherwise(F.array().cast("array<bigint>"))
    )


def winnowed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint``, the ``hash, position`` of each choice in order, to rows with a text column; null texts have none."""
    marks = (
        docs.withColumn("_piece", pieces(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_value", candidates(F.col("_piece"), F.lit(0)))
        .withColumn("_least", chosen(F.col("_value"), F.lit(0)))
        .withColumn("_marks", whole_if_short(F.col("_value"), F.col("_least"), F.col("_piece")))
    )
    as_pair = F.transform("_marks", lambda m: F.struct(F.shiftright(m, 31).alias("hash"), (LAST - F.pmod(m, F.lit(2**31))).cast("int").alias("position")))
    return marks.withColumn("fingerprint", as_pair).drop("_piece", "_value", "_least", "_marks")


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes; 1 for two empty fingerprints."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def digest(marks: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(marks))), 16, "0")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``row, doc_id, text, slot``, dealt into slots by id; each slot also gets, ``borrowed``, the last row of the slot before.

    In descending order of ids the next document of a slot's smallest is thus at hand without another shuffle
    of texts; the smallest of all borrows the largest. One row per slot comes to the driver.
    """
    spark = docs.sparkSession
    slots = slots_for(spark)
    slotted = docs.withColumn("slot", slot_of(F.col("doc_id"), slot_bounds(docs, "doc_id", slots)).cast("int"))
    rank = F.coalesce("doc_id", F.lit(-(2**63)))
    tops = slotted.groupBy("slot").agg(F.max(F.struct(rank.alias("r"), "row")).alias("top")).orderBy("slot").collect()
    lend = [(tops[k - 1].top.row, tops[k].slot) for k in range(len(tops))]
    borrowed = docs.join(F.broadcast(spark.createDataFrame(lend, "row long, slot int")), "row").dropDuplicates(["slot"])  # a row per slot
    both = slotted.withColumn("borrowed", F.lit(False)).unionByName(borrowed.withColumn("borrowed", F.lit(True)))
    return both.repartitionById(slots, F.col("slot"))


def compared(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per document.

    The edited text has its last third of code points replaced by the first ones of the next document, in
    descending order of ids, rows of equal ids by the hash of their text, ids that are null last; after the last comes the first.
    A null text is empty. A fingerprint is returned as the digest of its choices.
    """
    marked = (
        with_next(texts_of(docs))
        .withColumn("piece", pieces(F.col("text")))
        .withColumn("value", candidates(F.col("piece"), F.lit(0)))
        .withColumn("least", chosen(F.col("value"), F.lit(0)))
        .withColumn("marks", whole_if_short(F.col("value"), F.col("least"), F.col("piece")))
        .withColumn("hashes", hashes(F.col("marks")))
        .drop("piece", "value")
    )
    order = Window.partitionBy("slot").orderBy(F.desc("borrowed"), F.col("doc_id").asc_nulls_first(), "row")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    pair = (
        marked.select("*", F.lag("text").over(order).alias("next_text"), F.lag("hashes").over(order).alias("next_hashes"))
        .where("not borrowed")
        .withColumn("n_chars", n)
        .withColumn("head", F.substring("text", F.lit(1), n - third))
        .withColumn("edited", F.concat("head", F.substring("next_text", F.lit(1), third)))
        .withColumn("piece", pieces(F.col("edited")))
        # All pieces of the head but its last are pieces of the text; so are the choices among them.
        .withColumn("same", F.greatest(F.lit(0), F.regexp_count("head", F.lit(PIECE)) - 1 - GRAM + 1 - WINDOW + 1))
    )
    done = (
        pair.withColumn("value", candidates(F.col("piece"), F.col("same")))
        .withColumn("more", chosen(F.col("value"), F.lit(0)))
        .withColumn("joined", F.concat(F.slice("least", F.lit(1), F.col("same")), F.col("more")))
        .withColumn(
            "edited_marks",
            F.when(F.col("same") > 0, F.array_distinct("joined")).otherwise(whole_if_short(F.col("value"), F.col("more"), F.col("piece"))),
        )
    )
    return done.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("marks")).alias("fingerprint"),
        digest(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), hashes(F.col("edited_marks"))).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
