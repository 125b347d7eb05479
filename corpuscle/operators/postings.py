"""Keyword search on stored postings.

The index numbers chunks in the order of repository and id and cuts the numbers into ranges of 1024. A row of the
postings table holds what one word has in one range, or a part of it: chunks, counts, lengths, and the highest BM25 part that any of
these chunks gets from the word. Rows are filed by a hash of the word, so a search reads the buckets of its words only.

A search first reads the bounds alone and sums them by query and range. The few most promising ranges of each query
are scored, which gives the score that a hit must have, and then only ranges that can still hold one. Ranges are scored
as groups of bounded size, for all their queries at once; no more than the best of a range leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators.keyword import K1, B, DIGITS
from corpuscle.session import written

RANGE_BITS = 10
SEEDS = 4
SLACK = 1e-5
BUCKET, PART = "bucket", "part"
_COUNTED = "term string, range long, docs array<long>, tfs array<int>, lens array<int>"
_BLOCKS = "range long, term string, docs array<long>, tfs array<int>, lens array<int>, bound double"
_HITS = "query_id {}, repo_id string, id string, rank double"


def _count(batches):
    """What each word has in the ranges of a batch, by one sort a batch; chunks come in the order of their numbers."""
    for batch in batches:
        words = batch.column("words")
        length = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = batch.column("doc").to_numpy()
        coded = words.flatten().dictionary_encode()
        row = np.repeat(np.arange(batch.num_rows), length)
        kinds = max(1, len(coded.dictionary))
        cells, counts = np.unique(row * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        rows, code = cells // kinds, cells % kinds
        span = doc[rows] >> RANGE_BITS
        order = np.lexsort((code, span))  # stable, so that chunks stay in order
        rows, code, span, counts = rows[order], code[order], span[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (span[1:] != span[:-1])])[: len(rows)])
        offsets = pa.array(np.append(first, len(rows)).astype(np.int32))
        lists = [doc[rows], counts.astype(np.int32), length[rows].astype(np.int32)]
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(code[first])).cast(pa.string()), pa.array(span[first])]
            + [pa.ListArray.from_arrays(offsets, pa.array(values)) for values in lists],
            names=["term", "range", "docs", "tfs", "lens"],
        )


class Index:
    """Stored postings, chunk numbers and statistics under one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def bucket_of(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def build(self, chunks: DataFrame, content: str = "content") -> None:
        """Indexes ``(repo_id, id, content)``. A chunk without words counts as a chunk and is never found."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = chunks.select(
            F.col("repo_id").cast("string").alias("repo_id"), F.col("id").cast("string").alias("id"),
            F.coalesce(F.col(content), F.lit("")).alias("_content"),
        )
        order = [F.col("repo_id").asc_nulls_first(), F.col("id").asc_nulls_first()]
        sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        # Texts are sorted, not arrays of their words, which are several times as large
        numbered = sorted_rows.select("repo_id", "id", text.words(F.col("_content")).alias("words"), F.monotonically_increasing_id().alias("doc"))
        numbered = written(numbered, "numbered")
        docs = numbered.select("doc", F.shiftright("doc", RANGE_BITS).alias("range"), "repo_id", "id", F.size("words").alias("len"))
        docs.withColumn(PART, F.shiftright("doc", 33).cast("int")).write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/chunks")
        self.docs().groupBy(PART, "range", "repo_id").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("words")).write.mode(
            "overwrite"
        ).parquet(f"{self.path}/ranges")
        _, average = self.statistics()
        impact = lambda tf, size: tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))
        counted = numbered.select("doc", "words").mapInArrow(_count, _COUNTED)
        # The one shuffle. A range lies in one partition; the few that are split over batches have a row for each
        by_range = counted.select(
            "term", "range", F.size("docs").alias("n"), F.array_max(F.zip_with("tfs", "lens", impact)).alias("bound"),
            "docs", "tfs", "lens", self.bucket_of(F.col("term")).alias(BUCKET),
        )
        spread = by_range.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "term", "range")
        spread.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/postings")

    def docs(self) -> DataFrame:
        schema = f"doc long, range long, repo_id string, id string, len int, {PART} int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/chunks")

    def ranges(self) -> DataFrame:
        return self.spark.read.schema(f"{PART} int, range long, repo_id string, n long, words long").parquet(f"{self.path}/ranges")

    def postings(self, terms: DataFrame) -> DataFrame:
        """Rows of the buckets that ``terms`` have; the list is no longer than the number of buckets."""
        schema = f"term string, range long, n int, bound double, docs array<long>, tfs array<int>, lens array<int>, {BUCKET} int"
        found = [r[0] for r in terms.select(self.bucket_of(F.col("term"))).distinct().collect()]
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings").where(F.col(BUCKET).isin(found))

    def statistics(self) -> tuple[int, float]:
        """Number of chunks and their average length in words."""
        row = self.ranges().agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        n = row["n"] or 0
        return n, max((row["words"] or 0) / max(n, 1), 1e-12)

    def search(self, queries: DataFrame, limit: int = 10, min_rank: float | None = None, seeds: int = SEEDS) -> DataFrame:
        """``query_id, position, repo_id, id, rank`` of the best chunks for ``query_id, text[, repo_id]``.

        A query with a repository is asked of its chunks only; statistics are those of the whole index. ``rank`` is the
        BM25 score rounded to six digits, equal ranks come by id and repository. The result is exact.
        """
        n, average = self.statistics()
        kind = queries.schema["query_id"].dataType.simpleString()
        repo = F.col("repo_id").cast("string") if "repo_id" in queries.columns else F.lit(None).cast("string")
        asked = queries.select("query_id", repo.alias("asked_repo"), F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
        asked = written(asked, "asked")
        terms = asked.select("term").distinct()
        postings = self.postings(terms)
        meta = written(postings.select("term", "range", "n", "bound").join(terms, "term", "left_semi"), "bounds")
        df = meta.groupBy("term").agg(F.sum("n").alias("df"))
        weighted = written(asked.join(df, "term").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))), "weighted")

        held = self.ranges().select("range", F.col("repo_id").alias("_repo"))
        bound = weighted.join(meta.drop("n"), "term").groupBy("query_id", "asked_repo", "range").agg(F.sum(F.col("idf") * F.col("bound")).alias("most"))
        scoped = bound.where("asked_repo is not null").join(held, (F.col("asked_repo") == F.col("_repo")) & (bound["range"] == held["range"]), "left_semi")
        pairs = written(bound.where("asked_repo is null").unionByName(scoped), "pairs")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "range"))
        first = written(pairs.withColumn("nth", nth).where(F.col("nth") <= seeds).drop("nth"), "seeds")

        hits = written(self._scored(first, weighted, postings, average, limit, kind), "seed-hits")
        best = hits.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("rank"), False), F.lit(limit - 1)).alias("least"))
        rest = pairs.join(first.select("query_id", "range"), ["query_id", "range"], "left_anti").join(best, "query_id", "left")
        rest = written(rest.where(F.col("least").isNull() | (F.col("most") >= F.col("least") - SLACK)).drop("least"), "rest")
        if not rest.isEmpty():
            hits = hits.unionByName(self._scored(rest, weighted, postings, average, limit, kind))
        if min_rank is not None:
            hits = hits.where(F.col("rank") >= min_rank)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"), "id", "repo_id"))
        return hits.withColumn("position", place).where(F.col("position") <= limit).select("query_id", "position", "repo_id", "id", "rank")

    def _scored(self, pairs: DataFrame, weighted: DataFrame, postings: DataFrame, average: float, limit: int, kind: str) -> DataFrame:
        """The best of each pair of query and range; a range's words, chunks and queries meet in one group."""
        parts = self.ranges().select(PART, "range").distinct()
        ranges = pairs.select("range").distinct().join(parts, "range")
        words = weighted.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idfs"))
        wanted = pairs.join(words, "query_id").select("range", "query_id", "asked_repo", "terms", "idfs")
        used = pairs.select("range", "query_id").join(weighted.select("query_id", "term"), "query_id").select("range", "term").distinct()
        # Numbers of the ranges, a long for 1024 chunks, so that no postings of other ranges move
        near = postings.join(F.broadcast(pairs.select("range").distinct()), "range", "left_semi")
        blocks = near.select("range", "term", "docs", "tfs", "lens").join(used, ["range", "term"], "left_semi")
        chunks = self.docs().join(ranges, [PART, "range"], "left_semi").select("range", "doc", "repo_id", "id")
        everything = wanted.unionByName(blocks, allowMissingColumns=True).unionByName(chunks, allowMissingColumns=True)
        return everything.groupBy("range").applyInArrow(_scorer(average, limit), _HITS.format(kind))


def _scorer(average: float, limit: int):
    def run(table: pa.Table) -> pa.Table:
        is_query, is_block = pc.is_valid(table.column("terms")), pc.is_valid(table.column("docs"))
        queries = table.filter(is_query)
        chunks = table.filter(pc.is_valid(table.column("doc"))).sort_by("doc")
        doc = chunks.column("doc").to_numpy()
        parts = {}
        for block in table.filter(is_block).select(["term", "docs", "tfs", "lens"]).to_pylist():
            tf, size = np.array(block["tfs"], np.float64), np.array(block["lens"], np.float64)
            held = parts.setdefault(block["term"], [])
            held.append((np.searchsorted(doc, block["docs"]), tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))))
        repo, ids = chunks.column("repo_id").to_numpy(zero_copy_only=False), chunks.column("id").to_numpy(zero_copy_only=False)
        which, at, rank = [], [], []
        for k, (asked, terms, idfs) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("asked_repo", "terms", "idfs")))):
            total = np.zeros(len(doc))
            for term, idf in zip(terms, idfs):
                for place, part in parts.get(term, ()):
                    total[place] += idf * part
            found = np.flatnonzero(total > 0 if asked is None else (total > 0) & (repo == asked))
            total = np.round(total, DIGITS)
            chosen = sorted(found.tolist(), key=lambda i: (-total[i], ids[i] or "", repo[i] or ""))[:limit]
            which += [k] * len(chosen)
            at += chosen
            rank += total[chosen].tolist()
        return pa.table(
            {
                "query_id": queries.column("query_id").take(pa.array(which, pa.int64())),
                "repo_id": chunks.column("repo_id").take(pa.array(at, pa.int64())),
                "id": chunks.column("id").take(pa.array(at, pa.int64())),
                "rank": pa.array(rank, pa.float64()),
            }
        )

    return run
