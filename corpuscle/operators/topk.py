"""Batched top-k over a large corpus.

A block of queries of bounded size goes to every task. Each task walks its
corpus partition in Arrow batches, scores a batch against all queries at once
with a matrix product and keeps only the best k rows of each query, so a
partition hands at most ``queries * k`` rows to the one small shuffle by query
that merges the partial results. Nothing is paired that is not already among a
partition's best, no corpus row is shuffled, and every row is looked at.

More queries than one block holds are worked off in several blocks, one corpus
pass each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.session import written

BLOCK_ROWS = 4096
_CELLS = 1 << 21
_EXACT_CELLS = 1 << 18


@dataclass
class QueryBlock:
    """Queries of one corpus pass, held on the driver because their number is bounded."""

    ids: pa.Array
    k: np.ndarray
    columns: pa.Table

    def __len__(self) -> int:
        return len(self.ids)


def query_blocks(queries: DataFrame, block_rows: int = BLOCK_ROWS) -> list[QueryBlock]:
    """Fetch ``(query_id, k, ...)`` in blocks whose size is checked, never more than one over."""
    head = queries.limit(block_rows + 1).toArrow()
    if head.num_rows <= block_rows:
        return [_block(head)]
    queries = written(queries, "queries")
    parts = math.ceil(2 * queries.count() / block_rows)
    slot = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    blocks = []
    for part in range(parts):
        table = queries.where(slot == part).limit(block_rows * 2 + 1).toArrow()
        if table.num_rows > block_rows * 2:
            raise ValueError("query ids must be unique")
        if table.num_rows:
            blocks.append(_block(table))
    return blocks


def _block(table: pa.Table) -> QueryBlock:
    ids = table.column("query_id").combine_chunks()
    return QueryBlock(ids, table.column("k").to_numpy().astype(np.int64), table)


Scorer = Callable[[pa.RecordBatch], tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]]


def scan_topk(
    corpus: DataFrame,
    block: QueryBlock,
    make_scorer: Callable[[], Scorer],
    payload: list[str],
    id_col: str,
    match_on: list[str],
    meta: str | None = None,
) -> DataFrame:
    """Best ``k`` rows of each query per partition; lower distance is better, ties go to the lower id.

    With ``meta``, a map column of rows and queries, a row has to have all entries of the query's map. A scorer maps a batch to a (rows, queries) matrix of distances that may be
    off by rounding, and a function giving exact distances of chosen cells.
    """
    spark = corpus.sparkSession
    fields = {f.name: f for f in corpus.schema.fields}
    id_type = pa_type_to_spark(block.ids.type)
    schema = T.StructType(
        [T.StructField("query_id", id_type), T.StructField("k", T.LongType()), T.StructField("distance", T.DoubleType())]
        + [fields[name] for name in payload]
    )
    shared = spark.sparkContext.broadcast(
        (block.ids, block.k, {name: block.columns.column(name).to_pylist() for name in match_on}, condition_sets(block, meta))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ks, wanted, sets = shared.value
        score = make_scorer()
        best: pa.Table | None = None
        bound = np.full(len(ids), np.inf)
        for batch in batches:
            step = max(1, _CELLS // max(1, len(ids)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                best = _merge(part, score, best, bound, ks, wanted, payload, id_col, meta, sets)
        if best is not None and best.num_rows:
            q = best.column("_q").to_numpy()
            columns = [ids.take(pa.array(q)), pa.array(ks[q]), best.column("_d").combine_chunks()]
            columns += [best.column(name).combine_chunks() for name in payload]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return corpus.mapInArrow(run, schema)


def condition_sets(block: QueryBlock, meta: str | None) -> tuple[np.ndarray, dict[str, list[str | None]]] | None:
    """Number of each query's set of conditions, and for each name the value that each different set asks for."""
    if meta is None:
        return None
    sets: dict[tuple, int] = {}
    asked = [tuple(sorted(m or [])) for m in block.columns.column(meta).to_pylist()]
    of_query = np.array([sets.setdefault(a, len(sets)) for a in asked], np.int64)
    names = sorted({name for a in sets for name, _ in a})
    return of_query, {name: [dict(a).get(name) for a in sets] for name in names}


def _allowed(column: pa.Array, names: dict[str, list[str | None]], sets: int) -> np.ndarray:
    """Which rows have all that a set asks for, as a (rows, sets) matrix; each name is looked up once a batch."""
    out = np.ones((len(column), sets), bool)
    for name, values in names.items():
        found = pc.map_lookup(column, pa.scalar(name, column.type.key_type), "first")
        known = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}))}
        codes = np.asarray(pc.index_in(found, value_set=pa.array(list(known), found.type)).fill_null(-1))
        asked = np.array([-2 if v is None else known[v] for v in values])
        out &= (codes[:, None] == asked[None, :]) | (asked == -2)[None, :]
    return out


def _merge(part, score, best, bound, ks, wanted, payload, id_col, meta=None, sets=None):
    rough, exact = score(part)
    if sets and sets[1]:
        of_query, names = sets
        allowed = _allowed(part.column(part.schema.get_field_index(meta)), names, of_query.max() + 1)
        rough[~allowed[:, of_query]] = np.inf
    for name, values in wanted.items():
        _mask(rough, part.column(part.schema.get_field_index(name)), values)
    depth = int(ks.max()) if len(ks) else 0
    if depth and len(rough) > depth:
        limit = np.minimum(bound, np.partition(rough, depth - 1, axis=0)[depth - 1])
    else:
        limit = bound.copy()
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(limit), limit, 0)))
    rows, cols = np.nonzero((rough <= limit + slack) & np.isfinite(rough))
    if not len(rows):
        return best
    found = pa.Table.from_batches([part]).take(pa.array(rows)).select(payload)
    found = found.append_column("_q", pa.array(cols)).append_column("_d", pa.array(exact(rows, cols)))
    table = found if best is None else pa.concat_tables([best, found])
    order = pc.sort_indices(
        table, sort_keys=[("_q", "ascending"), ("_d", "ascending"), *((c, "ascending") for c in ties(id_col, payload))]
    )
    table = table.take(order)
    q = table.column("_q").to_numpy()
    starts = np.searchsorted(q, np.arange(len(ks)))
    rank = np.arange(len(q)) - starts[q]
    kept = table.filter(pa.array(rank < ks[q])).combine_chunks()
    q, d = kept.column("_q").to_numpy(), kept.column("_d").to_numpy()
    count = np.bincount(q, minlength=len(ks))
    full = (count >= ks) & (ks > 0)
    last = np.cumsum(count) - 1
    bound[full] = d[last[full]]
    return kept


def _mask(rough: np.ndarray, column: pa.Array, values: list) -> None:
    """Rule out rows whose column differs from what a query asks for (null asks for nothing)."""
    known = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}))}
    if not known:
        return
    codes = pc.index_in(column, value_set=pa.array(list(known), type=column.type))
    codes = np.asarray(codes.fill_null(-1))
    asked = np.array([-2 if v is None else known[v] for v in values])
    rough[(codes[:, None] != asked[None, :]) & (asked != -2)[None, :]] = np.inf


def ties(id_col: str, columns: list[str]) -> list[str]:
    """What orders rows of equal distance: the id, and the repository where there is one."""
    return [id_col, *(["repo_id"] if "repo_id" in columns and id_col != "repo_id" else [])]


def pa_type_to_spark(kind: pa.DataType) -> T.DataType:
    if pa.types.is_int64(kind):
        return T.LongType()
    if pa.types.is_int32(kind):
        return T.IntegerType()
    if pa.types.is_int16(kind):
        return T.ShortType()
    if pa.types.is_int8(kind):
        return T.ByteType()
    return T.StringType()


def merge_partials(partials: list[DataFrame], id_col: str) -> DataFrame:
    """Final rank over the partitions' partial results; one shuffle by query."""
    everything = partials[0]
    for more in partials[1:]:
        everything = everything.unionByName(more)
    order = Window.partitionBy("query_id").orderBy("distance", *ties(id_col, everything.columns))
    return everything.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k"))


def vector_scorer(vector: str, targets: np.ndarray, metric: str) -> Callable[[], Scorer]:
    """Scorer of vectors against the query matrix ``targets``."""
    target_sq = (targets * targets).sum(axis=1)
    dim = targets.shape[1]

    def make() -> Scorer:
        def score(batch: pa.RecordBatch):
            column = batch.column(batch.schema.get_field_index(vector))
            flat = np.asarray(column.flatten()).astype(np.float64)
            if len(flat) != len(column) * dim or not (np.diff(np.asarray(column.offsets)) == dim).all():
                raise ValueError(f"vectors must all have {dim} dimensions")
            x = flat.reshape(len(column), dim)
            dots = x @ targets.T
            if metric == "l2sq":
                rough = dots  # in place: a matrix of this size is held once
                rough *= -2
                rough += (x * x).sum(axis=1)[:, None]
                rough += target_sq[None, :]
                np.maximum(rough, 0, out=rough)
            elif metric == "inner_product":
                rough = 1 - dots
            else:
                norm = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt(target_sq)[None, :]
                rough = 1 - dots / norm
            return rough, lambda rows, cols: _exact(x, targets, rows, cols, metric)

        return score

    return make


def _exact(x, targets, rows, cols, metric) -> np.ndarray:
    """Distances summed left to right, so that equal vectors tie exactly."""
    out = np.empty(len(rows))
    step = max(1, _EXACT_CELLS // max(1, x.shape[1]))

    def total(a):
        return np.cumsum(a, axis=1)[:, -1]

    for s in range(0, len(rows), step):
        a, b = x[rows[s : s + step]], targets[cols[s : s + step]]
        if metric == "l2sq":
            out[s : s + step] = total((a - b) * (a - b))
        elif metric == "inner_product":
            out[s : s + step] = 1 - total(a * b)
        else:
            out[s : s + step] = 1 - total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))
    return out
