"""Latest job states from a stream of job events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.sources.store import Table


def job_status_stream(events: DataFrame, table: Table, checkpoint: str):
    """Keep ``table`` at the latest state per job.

    State holds one row per job; each micro-batch writes only the jobs it changed.
    """
    moment = F.struct("ts", "event_id")
    latest = events.groupBy("job_id").agg(
        F.max_by("state", moment).alias("state"),
        F.max_by("reason", moment).alias("reason"),
        F.max("ts").alias("changed_at"),
        F.count_if(F.col("state") == "failed").alias("attempts"),
    )

    def apply(batch: DataFrame, _: int) -> None:
        batch.persist()
        table.upsert(batch)
        batch.unpersist()

    return (
        latest.writeStream.outputMode("update").foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
