"""Ranked keyword search (BM25) over chunk texts.

First pass: document frequencies of the words that occur in queries, and the
average length, by one partial aggregation. Second pass: every task scores its
chunks against all queries and keeps the best per query (see ``topk``), so
neither postings of frequent words nor query-chunk pairs are ever shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators import filters as FL
from corpuscle.operators import topk

K1 = 1.2
B = 0.75
DIGITS = 6


def keyword_search(
    corpus: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    min_rank: float | None = None,
    filters: dict | None = None,
    *,
    id_col: str = "id",
    content: str = "content",
    payload: list[str] | None = None,
) -> DataFrame:
    """Best chunks per query ``(query_id, text)``: ``(query_id, position, payload..., rank)``.

    ``rank`` is the BM25 score rounded to six digits; equal ranks are ordered by id.
    Only chunks that share a word with the query are found.
    """
    payload = list(dict.fromkeys([id_col, *(payload or [])]))
    wanted = queries.select(
        "query_id", F.lit(limit).cast("long").alias("k"), F.array_distinct(text.words(F.col("text"))).alias("words")
    )
    rows = FL.apply_filter(corpus, filters).select(
        *payload, text.words(F.coalesce(F.col(content), F.lit(""))).alias("_words")
    )
    partials = []
    for block in topk.query_blocks(wanted):
        words = pc.unique(pc.list_flatten(block.columns.column("words").combine_chunks()))
        weights = _weights(rows, words)
        scorer = _bm25_scorer(block, words, *weights)
        partials.append(topk.scan_topk(rows, block, scorer, payload, id_col, []))
    hits = topk.merge_partials(partials, id_col).select(
        "query_id", F.col("rank").alias("position"), *payload, (-F.col("distance")).alias("rank")
    )
    return hits if min_rank is None else hits.where(F.col("rank") >= F.lit(min_rank))


def _weights(rows: DataFrame, words: pa.Array) -> tuple[np.ndarray, float]:
    """Inverse document frequency per query word and average chunk length, in one pass.

    The word list comes from one block of queries, so what is counted and
    collected is bounded by it, not by the corpus. The empty word, which no text
    contains, stands for every chunk once and carries the lengths.
    """
    spark = rows.sparkSession
    vocabulary = F.broadcast(spark.createDataFrame(pa.table({"word": [*words.to_pylist(), ""]})))
    counts = (
        rows.select(
            F.size("_words").alias("n_words"), F.explode(F.array_append(F.array_distinct("_words"), F.lit(""))).alias("word")
        )
        .join(vocabulary, "word", "left_semi")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("n_words").alias("n_words"))
        .toArrow()
    )
    found = {w: (n, total) for w, n, total in zip(*[c.to_pylist() for c in counts.columns])}
    n, total = found.get("", (0, 0))
    df = np.array([found.get(w, (0, 0))[0] for w in words.to_pylist()], dtype=np.float64)
    return np.log(1 + (n - df + 0.5) / (df + 0.5)), max(total / max(n, 1), 1e-12)


def _bm25_scorer(block: topk.QueryBlock, words: pa.Array, idf: np.ndarray, average: float):
    asked = block.columns.column("words").combine_chunks()
    members = np.zeros((len(words), len(block)))
    owner = np.repeat(np.arange(len(block)), np.diff(np.asarray(asked.offsets)))
    members[np.asarray(pc.index_in(asked.flatten(), value_set=words)), owner] = 1.0

    def make():
        def score(batch: pa.RecordBatch):
            column = batch.column(batch.schema.get_field_index("_words"))
            length = np.diff(np.asarray(column.offsets))
            codes = np.asarray(pc.index_in(column.flatten(), value_set=words).fill_null(-1))
            row = np.repeat(np.arange(len(column)), length)
            cells, counts = np.unique((row * len(words) + codes)[codes >= 0], return_counts=True)
            norm = K1 * (1 - B + B * length / average)
            r, w = cells // len(words), cells % len(words)
            value = idf[w] * counts * (K1 + 1) / (counts + norm[r])
            total = np.empty((len(column), len(block)))
            step = max(1, (1 << 22) // max(1, len(words)))
            for s in range(0, len(column), step):
                inside = (r >= s) & (r < s + step)
                dense = np.zeros((min(step, len(column) - s), len(words)))
                dense[r[inside] - s, w[inside]] = value[inside]
                total[s : s + step] = dense @ members
            rough = np.where(total > 0, -np.round(total, DIGITS), np.inf)
            return rough, lambda rows, cols: rough[rows, cols]

        return score

    return make
