"""Conversation memory: session summaries and context windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Messages kept per session and seconds until a session expires.
CONTEXT_WINDOW = 20
TTL_SECONDS = 3600


def summary(messages: DataFrame) -> DataFrame:
    """``created_at, last_accessed_at, message_count`` per session."""
    return messages.groupBy("session_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_accessed_at"), F.count(F.lit(1)).alias("message_count")
    )


def context_window(messages: DataFrame, n: int = CONTEXT_WINDOW, order: str = "turn") -> DataFrame:
    """The newest n messages per session; each partition is cut to n per session before the shuffle."""
    newest = Window.partitionBy("session_id").orderBy(F.desc(order))
    return messages.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= n).drop("_nth")


def sessionize(events: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Activity of a user in sessions that end after ``ttl_seconds`` without an event.

    Events of one time slot as long as the gap always share a session, so a user's
    events are first reduced to one row per slot (partially before the shuffle);
    only slots are ordered per user, and their number depends on the time covered,
    not on how busy the user is.
    """
    micros = F.unix_micros("ts")
    gap = ttl_seconds * 1_000_000
    slots = events.groupBy("user_id", F.floor(micros / gap).alias("_slot")).agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    order = Window.partitionBy("user_id").orderBy("_slot")
    since = F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(order))
    opened = F.when(since < gap, 0).otherwise(1)
    numbered = slots.withColumn("_opened", opened).withColumn("_session", F.sum("_opened").over(order))
    return (
        numbered.groupBy("user_id", "_session")
        .agg(
            F.min("_first").alias("created_at"),
            F.max("_last").alias("last_accessed_at"),
            F.sum("_n").alias("message_count"),
        )
        .drop("_session")
    )
