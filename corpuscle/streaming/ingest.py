"""Incremental ingestion as a stream of changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import tables
from corpuscle.plans import ingest


def ingest_stream(files: DataFrame, corpus: ingest.Corpus, checkpoint: str, now: Column, prose_too: bool = False):
    """Writer that applies each micro-batch of ``(repo_id, path, content)`` to the corpus.

    The stream's checkpoint replaces the last processed commit. A batch that is
    replayed finds its signatures in place and changes nothing. Of several
    versions of a file in one batch one is taken, by content, as a batch has no order.
    """

    def apply(batch: DataFrame, _: int) -> None:
        files = tables.first_per_key(batch, ["repo_id", "path"], [F.sha2("content", 256)])
        ingest.run(corpus, files, now, prose_too=prose_too, partial=True)

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
