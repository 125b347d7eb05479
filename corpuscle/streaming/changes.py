"""A feed of file changes: updates, deletes and renames, applied in the order of their versions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpuscle.plans import ingest
from corpuscle.session import written
from corpuscle.sources.store import Table

UPDATE, DELETE, RENAME = "update", "delete", "rename"
CHANGES = "repo_id string, path string, version long, deleted boolean, content string"
_Change = Row("repo_id", "path", "version", "deleted", "content")


def versions(events: DataFrame) -> DataFrame:
    """``repo_id, path, version, deleted, content`` from ``repo_id, path, version, op, content, old_path``.

    A rename is the end of the old path and a version of the new one. Null versions are the oldest.
    """
    version = F.coalesce(F.col("version").cast("long"), F.lit(-(2**63)))
    here = F.struct("path", version.alias("version"), (F.col("op") == DELETE).alias("deleted"), "content")
    there = F.struct(F.col("old_path").alias("path"), version.alias("version"), F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("content"))
    moved = (F.col("op") == RENAME) & F.col("old_path").isNotNull() & (F.col("old_path") != F.col("path"))
    return events.select("repo_id", F.explode(F.when(moved, F.array(here, there)).otherwise(F.array(here))).alias("_v")).select("repo_id", "_v.*")


class NewestVersion(StatefulProcessor):
    """Lets a path's version pass if none as new has passed before; deleted paths are remembered as well.

    Of equal versions in one batch, as in an exchange of two names, one that lives goes before a deletion,
    then the greater content; the state holds the version, not the content.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "version long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = None
        for row in rows:
            found = (int(row.version), not row.deleted, row.content or "")
            if best is None or found > best[0]:
                best = (found, row.content)
        known = self.newest.get()
        if best is not None and (known is None or best[0][0] > known[0]):
            (version, lives, _), content = best
            self.newest.update((version,))
            yield _Change(key[0], key[1], version, not lives, content)

    def close(self) -> None:
        pass


def newest_versions(events: DataFrame) -> DataFrame:
    """The changes that count, see :func:`versions`; needs the RocksDB state store."""
    return versions(events).groupBy("repo_id", "path").transformWithState(NewestVersion(), CHANGES, "Update", "None")


def once(commits: Table, stream: str, number: int, apply: Callable[[], None]) -> bool:
    """Applies a micro-batch unless the stream's committed number says that it has been; commits the number after the data."""
    last = commits.lookup(stream=stream).first()
    if last and last["batch"] >= number:
        return False
    apply()
    commits.upsert(commits.spark.createDataFrame([(stream, number)], "stream string, batch long"))
    return True


def ingest_changes(events: DataFrame, corpus: ingest.Corpus, checkpoint: str, now: Column, stream: str = "changes", prose_too: bool = False):
    """Writer that applies each micro-batch of changes to the corpus and commits its number with the data.

    A batch that failed between two tables is applied again as a whole, which changes nothing twice; one that was
    committed before the checkpoint was is recognised by its number.
    """

    def apply(batch: DataFrame, number: int) -> None:
        changed = written(batch, "changes")  # runs the stateful part once, whatever happens to the rows
        once(corpus.commits, stream, number, lambda: ingest.apply_changes(corpus, changed, now, prose_too=prose_too))

    return (
        newest_versions(events).writeStream.outputMode("update").foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
