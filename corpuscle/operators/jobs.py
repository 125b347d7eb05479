"""Ingestion-run ledger: an append-only table of job events and its views.

Events are ``(job_id, ts, event_id, state, reason[, data, stacktrace])``;
``event_id`` breaks ties of equal times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attempts and first delay of a job, and how long finished jobs are kept.
ATTEMPTS = 3
BACKOFF_SECONDS = 5
KEEP_COMPLETED_SECONDS = 3600
KEEP_COMPLETED = 100
KEEP_FAILED_SECONDS = 24 * 3600


def progress(state: Column) -> Column:
    return F.when(state == "completed", 100).otherwise(0).cast("int")


def latest(events: DataFrame) -> DataFrame:
    """Current state of every job; one partial aggregation, whatever a job's number of events."""
    moment = F.struct("ts", "event_id")
    return events.groupBy("job_id").agg(
        F.max_by("state", moment).alias("state"),
        F.max_by("reason", moment).alias("reason"),
        F.min("ts").alias("queued_at"),
        F.max(F.when(F.col("state") == "active", F.col("ts"))).alias("processed_on"),
        F.max("ts").alias("changed_at"),
        F.count_if(F.col("state") == "failed").alias("attempts"),
    )


def status(events: DataFrame) -> DataFrame:
    return latest(events).select("job_id", "state", progress(F.col("state")).alias("progress"))


def lookup(wanted: DataFrame, events: DataFrame) -> DataFrame:
    """Status of wanted jobs; unknown ids are kept with ``found = false``."""
    found = wanted.join(status(events), "job_id", "left")
    return found.withColumn("found", F.col("state").isNotNull())


def failed(events: DataFrame) -> DataFrame:
    """Failed jobs with their reason, each row with the number of failed jobs."""
    rows = latest(events).where("state = 'failed'").select(
        "job_id", F.coalesce("reason", F.lit("Unknown error")).alias("failed_reason"), "attempts",
        F.col("changed_at").alias("failed_at"),
    )
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.select(F.lit("repository").alias("queue_type"), "*", total.alias("total_failed"))


def failed_details(events: DataFrame) -> DataFrame:
    """Failed jobs with times and the reasons of all their failures, newest first."""
    now = latest(events).where("state = 'failed'")
    failures = events.where("state = 'failed'").join(now.select("job_id"), "job_id", "left_semi")
    return now.join(_stacks(failures), "job_id").select(
        "job_id", F.coalesce("reason", F.lit("Unknown error")).alias("failed_reason"),
        F.concat_ws("\n", "stack").alias("stacktrace"), "attempts", "queued_at", "processed_on",
        F.col("changed_at").alias("finished_on"),
    )


def _stacks(failures: DataFrame) -> DataFrame:
    """All reasons per job, newest first; they are gathered in partial aggregates before the shuffle."""
    reason = F.coalesce("reason", F.lit("Unknown error")).alias("r")
    stack = F.sort_array(F.collect_list(F.struct("ts", "event_id", reason)), asc=False)
    return failures.groupBy("job_id").agg(F.transform(stack, lambda s: s["r"]).alias("stack"))


def retry(events: DataFrame, jobs: DataFrame | None, now: Column) -> DataFrame:
    """New ``queued`` events for failed jobs, all of them or the wanted ones."""
    again = latest(events).where("state = 'failed'")
    if jobs is not None:
        again = again.join(jobs.select("job_id"), "job_id", "left_semi")
    return again.select("job_id", now.alias("ts"), F.lit("queued").alias("state"))


def retry_outcome(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """What a retry of each wanted job does: requeued, refused with its state, or unknown."""
    known = jobs.select("job_id").join(latest(events).select("job_id", "state"), "job_id", "left")
    outcome = (
        F.when(F.col("state").isNull(), "not found")
        .when(F.col("state") == "failed", "requeued")
        .otherwise(F.concat(F.lit("not failed: "), "state"))
    )
    return known.select("job_id", outcome.alias("outcome"))


def retry_schedule(events: DataFrame) -> DataFrame:
    """Time of the next attempt of each failed job; null once the attempts are used up."""
    delay = (F.lit(BACKOFF_SECONDS) * F.pow(F.lit(2), F.col("attempts") - 1)).cast("decimal(18,6)")
    at = F.col("changed_at") + F.make_interval(*[F.lit(0)] * 6, delay)
    return latest(events).where("state = 'failed'").select(
        "job_id", "attempts", F.when(F.col("attempts") < ATTEMPTS, at).alias("next_attempt")
    )


def retained(events: DataFrame, now: Column) -> DataFrame:
    """Finished jobs a compaction keeps.

    The last hundred completed jobs are a top-k over all jobs, done per
    partition first, and then the age limit applies.
    """
    jobs = latest(events)

    def age_within(seconds: int) -> Column:
        return F.col("changed_at") >= now - F.make_interval(*[F.lit(0)] * 6, F.lit(seconds).cast("decimal(18,6)"))

    completed = (
        jobs.where("state = 'completed'").orderBy(F.desc("changed_at"), "job_id").limit(KEEP_COMPLETED)
        .where(age_within(KEEP_COMPLETED_SECONDS))
    )
    kept_failed = jobs.where("state = 'failed'").where(age_within(KEEP_FAILED_SECONDS))
    return completed.unionByName(kept_failed).select("job_id", "state", "changed_at")
