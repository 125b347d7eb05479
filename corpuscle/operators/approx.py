"""Approximate search on an inverted file.

Vectors are stored by cell, the cell of their nearest centre, with a residual code of one byte a dimension and
the length of what the code loses. A search probes the nearest cells of each query, and only their folders are read. The
first pass scores codes alone: what the code loses bounds how far the true distance may be, so the few rows that can
be among the best of the probed cells are known, and only their vectors are read and scored exactly. Within the
probed cells the result is exact; probing all cells is the exact search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions import vec
from corpuscle.operators import topk
from corpuscle.session import written

CELL = "cell"
SAMPLE_ROWS = 100_000
SLICE_ROWS = 1 << 16
LEVELS = 127
# Distances of one slice held at once; there are four such matrices.
TILE_CELLS = 1 << 19


def train_centres(corpus: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS, vector: str = "vector", seed: int = 42) -> np.ndarray:
    """k-means centres of about ``sample_rows`` vectors at most, drawn by hash; only the centres depend on the sample."""
    share = min(1.0, sample_rows / max(1, corpus.count()))
    drawn = corpus if share == 1 else corpus.where(F.pmod(F.xxhash64(vector), F.lit(1 << 20)) < int(share * (1 << 20)))
    features = drawn.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(features).clusterCenters())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dim:
        raise ValueError(f"vectors must all have {dim} dimensions")
    return flat.reshape(len(column), dim)


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cells of the ``n`` nearest centres of each row, nearest first, equal ones by number."""
    n = min(n, len(centres))
    rough = np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T, 0)
    limit = np.partition(rough, n - 1, axis=1)[:, n - 1 : n]
    rows, cells = np.nonzero(rough <= limit + 1e-9 * (1 + limit))
    order = np.lexsort((cells, topk._exact(x, centres, rows, cells, "l2sq"), rows))
    rows, cells = rows[order], cells[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < n], cells[place < n]


class InvertedFile:
    """Vectors of one folder, filed by cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, corpus: DataFrame, centres: np.ndarray, vector: str = "vector") -> None:
        """Stores ``id`` (unique), ``vector`` and all other columns of each row."""
        centres = np.asarray(centres, np.float64)
        dim = centres.shape[1]
        shared = self.spark.sparkContext.broadcast(centres)
        fields = [*corpus.schema.fields, T.StructField(CELL, T.IntegerType()), T.StructField("code", T.BinaryType())]
        fields += [T.StructField("scale", T.DoubleType()), T.StructField("loss", T.DoubleType())]

        def code(batches):
            for batch in batches:
                x = _matrix(batch.column(vector), dim)
                cell = nearest(x, shared.value, 1)[1]
                rest = x - shared.value[cell]
                scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / LEVELS
                codes = np.round(rest / scale[:, None]).astype(np.int8)
                loss = np.sqrt(((rest - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)
                made = [pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(loss)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[f.name for f in fields])

        coded = corpus.where(F.col(vector).isNotNull()).mapInArrow(code, T.StructType(fields))
        spread = coded.hint("rebalance", CELL).sortWithinPartitions(CELL, "id")
        spread.write.mode("overwrite").partitionBy(CELL).parquet(f"{self.path}/vectors")
        sizes = self.rows().groupBy(CELL).agg(F.count(F.lit(1)).alias("n"))
        found = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        found.join(sizes, CELL, "left").select(CELL, "centre", F.coalesce("n", F.lit(0)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int, probes: int, payload: list[str] | None = None, vector: str = "vector") -> DataFrame:
        """``query_id, rank, id, payload..., distance, score`` of the best ``k`` rows in the ``probes`` nearest cells."""
        held = self.spark.read.parquet(f"{self.path}/centres").orderBy(CELL).collect()  # as many rows as there are cells
        centres = np.array([r["centre"] for r in held])
        slices = {r[CELL]: -(-r["n"] // SLICE_ROWS) for r in held}
        shared = self.spark.sparkContext.broadcast((centres, slices))
        dim, kind = centres.shape[1], queries.schema["query_id"].dataType.simpleString()

        def probe(batches):
            for batch in batches:
                x = _matrix(batch.column("vector"), dim)
                rows, cells = nearest(x, shared.value[0], probes)
                count = np.array([shared.value[1].get(c, 0) for c in cells.tolist()], np.int64)
                again = np.repeat(np.arange(len(rows)), count)
                part = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
                taken = batch.take(pa.array(rows[again]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells[again], pa.int32()), pa.array(part, pa.int32())], names=["query_id", "target", CELL, "slice"])

        asked = queries.select("query_id", F.col(vector).cast("array<double>").alias("vector"))
        probing = written(asked.mapInArrow(probe, f"query_id {kind}, target array<double>, {CELL} int, slice int"), "probes")
        probed = sorted(r[0] for r in probing.select(CELL).distinct().collect())  # no longer than the list of cells
        rows = self.rows().where(F.col(CELL).isin(probed))
        id_kind = rows.schema["id"].dataType.simpleString()
        table = self.spark.createDataFrame([(c, n) for c, n in slices.items()], f"{CELL} int, slices int")
        codes = rows.select(CELL, "id", "code", "scale", "loss").join(F.broadcast(table), CELL)
        codes = codes.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).drop("slices")
        first = probing.groupBy(CELL, "slice").cogroup(codes.groupBy(CELL, "slice"))
        bounds = written(first.applyInArrow(_bounded(shared, k), f"query_id {kind}, {CELL} int, id {id_kind}, low double, high double"), "bounds")

        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("high"))
        enough = bounds.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("query_id").agg(F.max("high").alias("most"))
        near = bounds.join(enough, "query_id").where(F.col("low") <= F.col("most")).select("query_id", CELL, "id")
        wanted = list(dict.fromkeys(["id", *(payload or [])]))
        true = near.join(rows.select(CELL, F.col(vector).alias("_vector"), *wanted), [CELL, "id"]).join(asked, "query_id")
        scored = true.withColumn("distance", vec.l2sq(F.col("_vector"), F.col("vector")))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        best = scored.withColumn("rank", rank).where(F.col("rank") <= k)
        return best.select("query_id", "rank", *wanted, "distance", (1 - F.col("distance")).alias("score"))


def _bounded(shared, k: int):
    """For each query the rows of a slice whose least possible distance is within the k-th greatest possible one."""

    def run(queries: pa.Table, codes: pa.Table) -> pa.Table:
        ids, out = codes.column("id").combine_chunks(), []
        cell = queries.column(CELL)[0].as_py() if queries.num_rows else 0
        if queries.num_rows and codes.num_rows:
            centre = shared.value[0][cell]
            scale = codes.column("scale").to_numpy()[:, None]
            known = np.frombuffer(b"".join(c.as_py() for c in codes.column("code")), np.int8).reshape(codes.num_rows, -1) * scale
            known += centre
            loss = codes.column("loss").to_numpy()
            square = (known * known).sum(axis=1)
            targets = _matrix(queries.column("target").combine_chunks(), len(centre))
            step = max(1, TILE_CELLS // codes.num_rows)
            for at in range(0, len(targets), step):
                t = targets[at : at + step]
                far = known @ t.T  # in place from here on
                far *= -2
                far += square[:, None]
                far += (t * t).sum(axis=1)[None, :]
                np.sqrt(np.maximum(far, 0, out=far), out=far)
                margin = 1e-7 * (1 + far)
                margin += loss[:, None]
                high = far + margin
                most = np.partition(high, k - 1, axis=0)[k - 1] if len(high) > k else np.full(len(t), np.inf)
                far -= margin
                r, q = np.nonzero(far <= most)
                out.append((q + at, r, far[r, q], high[r, q]))
        q, r, low, high = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64 if i < 2 else np.float64) for i in range(4))
        return pa.table(
            {
                "query_id": queries.column("query_id").combine_chunks().take(pa.array(q, pa.int64())),
                CELL: pa.array(np.full(len(q), cell), pa.int32()),
                "id": ids.take(pa.array(r, pa.int64())),
                "low": pa.array(low, pa.float64()),
                "high": pa.array(high, pa.float64()),
            }
        )

    return run
