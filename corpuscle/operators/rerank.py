"""Second passes over search results: diverse selection, sentences that answer, and a second hop.

All three work on hits, of which a query has a bounded number, never on the corpus' rows one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions import text
from corpuscle.operators import search as S
from corpuscle.session import written

DIGITS = 9
SENTENCE = r"[^.!?]+[.!?]*"


def _greedy(score: np.ndarray, vectors: np.ndarray, k: int, balance: float) -> list[int]:
    """Positions in the order of choice; equally good ones in the order given."""
    gap = vectors[:, None, :] - vectors[None, :, :]
    alike = 1 - (gap * gap).sum(axis=2)
    picked: list[int] = []
    nearest = np.full(len(score), -np.inf)
    left = np.ones(len(score), bool)
    while left.any() and len(picked) < k:
        value = score if not picked else balance * score - (1 - balance) * nearest
        best = int(np.argmax(np.where(left, np.round(value, DIGITS), -np.inf)))
        picked.append(best)
        left[best] = False
        nearest = np.maximum(nearest, alike[best])
    return picked


def diversified(hits: DataFrame, k: int = S.DEFAULT_K, balance: float = 0.7, *, vector: str = "vector") -> DataFrame:
    """Maximal marginal relevance: of each query's hits the ``k`` that are near it and unlike each other.

    The first choice is the best score; each further one has the largest ``balance * score -
    (1 - balance) * similarity`` to the most similar hit chosen before, where similarity is 1 -
    squared distance as in ``score``; equally good ones go by rank. Needs ``query_id, rank, score`` and the
    vector; the columns stay but for the vector, ``rank`` becomes the order of choice and the old one
    is ``found_rank``. A group holds the hits of one query, whose number the search bounds by 300.
    Hits without a vector are dropped.
    """
    keep = [c for c in hits.columns if c not in (vector, "rank")]
    rows = hits.where(F.col(vector).isNotNull()).select(
        *[F.col(f"`{c}`") for c in keep], "rank", F.col(f"`{vector}`").cast("array<double>").alias("_vector")
    )
    out = T.StructType([rows.schema[c] for c in keep] + [T.StructField("found_rank", T.IntegerType()), T.StructField("rank", T.IntegerType())])

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank").combine_chunks()
        column = table.column("_vector").combine_chunks()
        vectors = np.asarray(column.flatten(), np.float64).reshape(table.num_rows, -1)
        order = _greedy(table.column("score").to_numpy().astype(np.float64), vectors, k, balance)
        chosen = table.take(pa.array(order, pa.int64()))
        rank = pa.array(np.arange(1, len(order) + 1), pa.int32())
        columns = [chosen.column(c) for c in keep] + [chosen.column("rank").cast(pa.int32()), rank]
        return pa.Table.from_arrays(columns, names=out.names)

    return rows.groupBy("query_id").applyInArrow(choose, out)


def answering_sentences(content: Column, asked: Column, keep: int = 3) -> Column:
    """The ``keep`` sentences that share most different words with ``asked``, in their order; null if none shares any.

    A sentence ends with ``.``, ``!`` or ``?``, or with the text. Of equally good sentences the earlier one is kept.
    """
    parts = F.regexp_extract_all(content, F.lit(SENTENCE), F.lit(0))
    rated = F.transform(
        parts,
        lambda part, at: F.struct(
            (-F.size(F.array_intersect(text.words(part), asked))).alias("worse"), at.alias("at"), F.trim(part).alias("part")
        ),
    )
    best = F.slice(F.array_sort(F.filter(rated, lambda s: s["worse"] < 0)), 1, keep)
    ordered = F.array_sort(F.transform(best, lambda s: F.struct(s["at"].alias("at"), s["part"].alias("part"))))
    return F.when(F.size(best) > 0, F.array_join(F.transform(ordered, lambda s: s["part"]), " "))


def compressed(hits: DataFrame, queries: DataFrame, keep: int = 3, *, content: str = "content") -> DataFrame:
    """Hits whose content is cut down to the sentences that answer their query ``(query_id, text)``.

    Hits without such a sentence go. Hits and queries meet by ``query_id``; nothing else moves.
    """
    asked = queries.select("query_id", F.array_distinct(text.words(F.coalesce("text", F.lit("")))).alias("_asked"))
    cut = hits.join(asked, "query_id").withColumn(content, answering_sentences(F.col(content), F.col("_asked"), keep))
    return cut.where(F.col(content).isNotNull()).drop("_asked")


def second_hop(
    corpus: DataFrame, queries: DataFrame, k: int = S.DEFAULT_K, seeds: int = 3, *, id_col: str = "id", vector: str = "vector"
) -> DataFrame:
    """What is near a query or near one of its ``seeds`` nearest rows: ``(query_id, rank, id, hops, via, distance)``.

    The distance over a seed is the sum of both squared distances; each row counts by its shortest way,
    of equal ones the direct one, then that over the smaller seed. A seed that many queries find is searched once.
    """
    width = max(k, seeds)
    first = written(S.similarity_search(corpus, queries, width, payload=[vector], id_col=id_col, vector=vector), "hop")
    start = first.where(F.col("rank") <= seeds).select("query_id", F.col(id_col).alias("via"), F.col("distance").alias("_so_far"), vector)
    asked = start.groupBy("via").agg(F.first(vector).alias("vector")).withColumnRenamed("via", "query_id")
    near = S.similarity_search(corpus, asked, width, id_col=id_col, vector=vector)
    over = start.select("query_id", "via", "_so_far").join(near.select(F.col("query_id").alias("via"), id_col, "distance"), "via")
    direct = first.select("query_id", id_col, F.lit(1).alias("hops"), F.lit(None).cast(corpus.schema[id_col].dataType).alias("via"), "distance")
    ways = direct.unionByName(
        over.select("query_id", id_col, F.lit(2).alias("hops"), "via", (F.col("_so_far") + F.col("distance")).alias("distance"))
    ).withColumn("distance", F.round("distance", DIGITS))
    best = ways.groupBy("query_id", id_col).agg(F.min(F.struct("distance", "hops", "via")).alias("way"))
    order = Window.partitionBy("query_id").orderBy("way.distance", id_col)
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", id_col, "way.hops", "way.via", "way.distance")
