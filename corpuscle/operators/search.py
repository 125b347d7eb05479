"""Similarity search, chunk search and parent search.

Queries are a DataFrame ``(query_id, vector[, k])``; the corpus has an id and a
vector column. Results carry ``rank`` and ``score``, for a DataFrame has no order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import vec
from corpuscle.operators import filters as FL
from corpuscle.operators import topk
from corpuscle.session import written

# Result counts of the search interface.
DEFAULT_K = 5
MAX_K = 100
OVERFETCH = 3
# As many candidates may leave a partition with all that is asked of them.
FEW_HITS = 8192
_ROW = "_corpus_row"


def normalize_k(k: Column) -> Column:
    """Absent, fractional and non-positive counts become 5, the rest is capped at 100."""
    unusable = k.isNull() | (k < 1) | (k != F.floor(k))
    return F.when(unusable, F.lit(DEFAULT_K)).otherwise(F.least(k, F.lit(MAX_K))).cast("int")


def with_k(queries: DataFrame, k: int | None, factor: int = 1) -> DataFrame:
    """Queries with their own or the common result count, times ``factor``."""
    if k is not None:
        return queries.withColumn("k", F.lit(k * factor).cast("long"))
    own = normalize_k(F.col("k")) if "k" in queries.columns else F.lit(DEFAULT_K)
    return queries.withColumn("k", (own * factor).cast("long"))


def similarity_search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    filters: dict | None = None,
    *,
    payload: list[str] | None = None,
    match_on: tuple[str, ...] = (),
    id_col: str = "id",
    vector: str = "vector",
    metric: str = "l2sq",
    factor: int = 1,
    block_rows: int = topk.BLOCK_ROWS,
    meta: str | None = None,
) -> DataFrame:
    """Exact k nearest rows of each query: ``(query_id, rank, payload..., distance, score)``.

    ``filters`` restricts the corpus for all queries before anything is scored
    and reaches the scan; ``match_on`` names columns on which a row has to equal
    the query's own value, where the query has one. ``meta`` names a map column: a row has to have all
    entries of the query's own map; equal sets of conditions are looked up once, so every query may have its own.
    """
    return _search(
        corpus, queries, k, filters, payload, match_on, id_col, vector, metric, factor, block_rows, meta
    )[0]


def _search(
    corpus, queries, k, filters, payload, match_on=(), id_col="id", vector="vector", metric="l2sq",
    factor=1, block_rows=topk.BLOCK_ROWS, meta=None,
) -> tuple[DataFrame, bool]:
    """Hits, and whether a single block of queries bounds their number."""
    payload = list(dict.fromkeys([id_col, *(payload or [])]))
    wanted = with_k(queries, k, factor).select(
        "query_id", F.col("vector").cast("array<double>").alias("vector"), "k", *match_on, *([meta] if meta else [])
    )
    rows = FL.apply_filter(corpus, filters).where(F.col(vector).isNotNull())
    rows = rows.select(*dict.fromkeys([*payload, vector, *match_on, *([meta] if meta else [])]))
    carried, stored = payload, rows
    blocks = [block for block in topk.query_blocks(wanted, block_rows) if len(block)]
    # Every partition hands on as many candidates as there are hits. A few weigh less than the partition. Of many, only
    # what orders them moves: the rows are stored once, for all blocks, and the hits alone fetch the rest by row number.
    apart = []
    if len(blocks) > 1 or sum(int(block.k.sum()) for block in blocks) > FEW_HITS:
        order = topk.ties(id_col, payload)
        apart = [c for c in payload if c not in order]
        carried = [*order, _ROW] if apart else payload
        stored = written(rows.withColumn(_ROW, F.monotonically_increasing_id()) if apart else rows, "corpus")
    scanned = stored.select(*dict.fromkeys([*carried, vector, *match_on, *([meta] if meta else [])]))
    partials = []
    for block in blocks:
        column = block.columns.column("vector").combine_chunks()
        targets = np.asarray(column.flatten(), dtype=np.float64).reshape(len(block), -1)
        scorer = topk.vector_scorer(vector, targets, metric)
        part = scanned
        for name in match_on:
            part = _prune(part, name, block)
        partials.append(topk.scan_topk(part, block, scorer, carried, id_col, list(match_on), meta))
    if not partials:
        kind = queries.schema["query_id"].dataType
        return rows.select(
            F.lit(None).cast(kind).alias("query_id"), F.lit(0).alias("rank"), *payload,
            F.lit(0.0).alias("distance"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("k"),
        ).where(F.lit(False)), True
    hits = topk.merge_partials(partials, id_col)
    if apart:
        hits = hits.join(stored.select(_ROW, *apart), _ROW).select("query_id", "k", "distance", *payload, "rank")
    return hits.withColumn("score", vec.similarity(F.col("distance"))), len(blocks) <= 1


def _prune(rows: DataFrame, name: str, block: topk.QueryBlock) -> DataFrame:
    """Where every query asks for a value, only rows with one of these values can match."""
    values = block.columns.column(name).unique().to_pylist()
    if None in values or len(values) > 1000:
        return rows
    return rows.where(F.col(name).isin(values))


def search_chunks(
    corpus: DataFrame, queries: DataFrame, k: int | None = None, filters: dict | None = None, **options
) -> DataFrame:
    """Nearest chunks themselves, with their metadata; those without content are dropped after the cut at k."""
    held = ["meta"] if "meta" in corpus.columns else []
    payload = list(dict.fromkeys(["repo_id", "content", *held, *options.pop("payload", [])]))
    hits = similarity_search(corpus, queries, k, filters, payload=payload, **options)
    return FL.has_content(hits).drop("k", "distance")


def parent_child(
    corpus: DataFrame,
    parents: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    filters: dict | None = None,
    **options,
) -> DataFrame:
    """Chunks vote for the documents they come from.

    Three times k chunks are fetched. Where any of them has a parent, the first
    k distinct parents in order of their best chunk are returned, as far as they
    exist; otherwise all fetched chunks with content are.
    Result: ``(query_id, rank, id, repo_id, content, score, is_parent)``, and ``meta`` where both tables have it.
    """
    held = ["meta"] if "meta" in corpus.columns and "meta" in parents.columns else []
    hits, bounded = _search(
        corpus, queries, k, filters, ["repo_id", "parent_id", "content", *held], factor=OVERFETCH, **options
    )
    # Documents and orphans both come from the hits: keep those few rows, scan the corpus once.
    hits = written(hits, "hits")
    per_query = Window.partitionBy("query_id")
    named = F.col("parent_id").isNotNull() & (F.col("parent_id") != "")
    hits = hits.withColumn("any_parent", F.max(named).over(per_query))

    first = Window.partitionBy("query_id", "repo_id", "parent_id").orderBy("rank")
    order = Window.partitionBy("query_id").orderBy("rank")
    picked = (
        hits.where(named)
        .withColumn("_nth", F.row_number().over(first))
        .where("_nth = 1")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.col("k") / OVERFETCH)
        .select("query_id", "rank", "repo_id", F.col("parent_id").alias("id"), "score")
    )
    swapped = fetch_parents(parents, F.broadcast(picked) if bounded else picked, tuple(held))
    orphans = FL.has_content(hits.where(~F.col("any_parent"))).select(
        "query_id", "rank", F.col("id").cast("string").alias("id"), "repo_id", "content", "score",
        F.lit(False).alias("is_parent"), *held,
    )
    return swapped.unionByName(orphans)


def fetch_parents(parents: DataFrame, picked: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Documents for picked ``(repo_id, id)`` pairs.

    With one block of queries there are at most block size times 100 picked rows
    of a few short columns, so the caller broadcasts them and the documents are
    scanned without a shuffle; with more blocks the planner chooses.
    """
    return (
        parents.select("repo_id", "id", "content", *more)
        .join(picked, ["repo_id", "id"], "inner")
        .select("query_id", "rank", "id", "repo_id", "content", "score", F.lit(True).alias("is_parent"), *more)
    )


def project(hits: DataFrame) -> DataFrame:
    """Content falls back to the metadata's text, then to ''."""
    content = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("metadata")["text"], F.lit(""))
    return hits.withColumn("content", content).withColumn("metadata", F.map_concat(
        F.map_filter("metadata", lambda key, _: key != "id"), F.create_map(F.lit("id"), F.col("id").cast("string"))
    ))


def memory(corpus: DataFrame, queries: DataFrame, user_id: str, kind: str, k: int | None = None) -> DataFrame:
    """Stored memories of one user and type near each query: ``(content, score, timestamp)``."""
    hits = similarity_search(
        corpus, queries, k, {"user_id": user_id, "type": kind}, payload=["content", "timestamp"]
    )
    return hits.select("query_id", "rank", "content", "score", "timestamp")


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = DEFAULT_K, damping: int = 60) -> DataFrame:
    """Hybrid ranking of several result lists ``(query_id, id, rank)``.

    Where all lists have a ``repo_id``, equal ids of two repositories are two hits.
    """
    key = ["repo_id", "id"] if all("repo_id" in hits.columns for hits in lists) else ["id"]
    votes = lists[0].select("query_id", *key, "rank")
    for more in lists[1:]:
        votes = votes.unionByName(more.select("query_id", *key, "rank"))
    fused = votes.groupBy("query_id", *key).agg(
        F.round(F.sum(1.0 / (F.lit(damping) + F.col("rank"))), 9).alias("fused_score")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), *reversed(key))
    return fused.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
