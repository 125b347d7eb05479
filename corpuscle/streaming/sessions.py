"""Session memory and session statistics on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpuscle.operators.sessions import CONTEXT_WINDOW, TTL_SECONDS
from corpuscle.session import written
from corpuscle.sources.store import Table

MEMORY = "session_id long, turn long, role string, text string"
_MESSAGE = "turn long, role string, text string"
_Message = Row("session_id", "turn", "role", "text")


class LastMessages(StatefulProcessor):
    """Keeps the newest messages of a session; a session expires after its time to live."""

    def __init__(self, window: int, ttl_seconds: int | None):
        self.window = window
        self.ttl_ms = ttl_seconds * 1000 if ttl_seconds else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", _MESSAGE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {m[0]: tuple(m) for m in self.messages.get()}
        for row in rows:
            if row.turn not in held:
                held[row.turn] = (row.turn, row.role, row.text)
            if len(held) > 4 * self.window:
                held = self._newest(held)
        held = self._newest(held)
        self.messages.put(list(held.values()))
        for message in held.values():
            yield _Message(key[0], *message)

    def _newest(self, held: dict[int | None, tuple]) -> dict[int | None, tuple]:
        """In the order of their turns; a message without one is the oldest."""
        turns = sorted(held, key=lambda turn: (turn is not None, turn))[-self.window :]
        return {turn: held[turn] for turn in turns}

    def close(self) -> None:
        pass


def session_memory(messages: DataFrame, window: int = CONTEXT_WINDOW, ttl_seconds: int | None = TTL_SECONDS) -> DataFrame:
    """For each changed session its newest messages; needs the RocksDB state store."""
    return messages.select("session_id", "turn", "role", "text").groupBy("session_id").transformWithState(
        LastMessages(window, ttl_seconds), MEMORY, "Update", "None"
    )


def session_stats(events: DataFrame, ttl_seconds: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Closed sessions per user. Events later than ``late`` and repeated ones are dropped."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .dropDuplicatesWithinWatermark(["event_id"])
        .groupBy("user_id", F.session_window("ts", f"{ttl_seconds} seconds").alias("session"))
        .agg(F.count(F.lit(1)).alias("message_count"))
        .select(
            "user_id", F.col("session.start").alias("created_at"),
            (F.col("session.end") - F.make_interval(*[F.lit(0)] * 6, F.lit(ttl_seconds).cast("decimal(18,6)"))).alias("last_accessed_at"),
            "message_count",
        )
    )


OPEN, CLOSED, GONE = "open", "closed", "gone"
_STATES = "user_id long, first long, last long, message_count long, state string"
_State = Row("user_id", "first", "last", "message_count", "state")


class OpenSessions(StatefulProcessor):
    """A user's open sessions as first and last moment and number of messages; emits each one that changed.

    A late message may join two sessions: the later one is then gone. A timer closes a session when the watermark has
    passed its time to live.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl_us = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getListState("sessions", "first long, last long, n long")

    def _wake(self, last: int) -> None:
        self.handle.registerTimer(-(-(last + self.ttl_us) // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = [tuple(int(x) for x in s) for s in self.sessions.get()]
        new: dict[int | None, int] = {}
        for row in rows:
            new.setdefault(row.event_id, int(row.moment))
        joined: list[tuple[int, int, int]] = []
        for first, last, n in sorted(old + [(t, t, 1) for t in new.values()]):
            if joined and first - joined[-1][1] < self.ttl_us:
                before = joined.pop()
                first, last, n = before[0], max(before[1], last), before[2] + n
            joined.append((first, last, n))
        self.sessions.put(joined)
        # One timer a user, never later than the first session to close; it is set again when it has passed
        soonest = min(last for _, last, _ in joined)
        if not old or soonest < min(last for _, last, _ in old):
            self._wake(soonest)
        starts = {s[0] for s in joined}
        for session in old:
            if session[0] not in starts:
                yield _State(key[0], *session, GONE)
        for session in sorted(set(joined) - set(old)):
            yield _State(key[0], *session, OPEN)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(int(x) for x in s) for s in self.sessions.get()]
        rest = [s for s in held if s[1] + self.ttl_us > now]
        if rest:
            if len(rest) < len(held):
                self.sessions.put(rest)
            self._wake(min(last for _, last, _ in rest))
        else:
            self.sessions.clear()
        for session in held:
            if session[1] + self.ttl_us <= now:
                yield _State(key[0], *session, CLOSED)

    def close(self) -> None:
        pass


def open_sessions(events: DataFrame, ttl_seconds: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Each change of a session, while it is open and when it closes; a message twice in a batch counts once."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    moments = timed.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("moment"))
    states = moments.groupBy("user_id").transformWithState(OpenSessions(ttl_seconds), _STATES, "Update", "EventTime")
    return states.select(
        "user_id", F.timestamp_micros("first").alias("created_at"), F.timestamp_micros("last").alias("last_accessed_at"), "message_count", "state"
    )


def keep_sessions(changes: DataFrame, table: Table, checkpoint: str):
    """Keeps ``table`` (by ``user_id, created_at``) at the last state of each session."""

    def apply(batch: DataFrame, _: int) -> None:
        rows = written(batch, "sessions")
        last = rows.groupBy("user_id", "created_at").agg(
            F.max_by(F.struct("last_accessed_at", "message_count", "state"), F.col("state") == CLOSED).alias("s")
        ).select("user_id", "created_at", "s.*")
        table.replace(last.where(F.col("state") != GONE), last)

    return changes.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


class ExpiringMessages(StatefulProcessor):
    """The newest messages of a session, which go when the watermark has passed its last one by the time to live."""

    def __init__(self, window: int, ttl_seconds: int):
        self.window, self.ttl_ms = window, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", _MESSAGE)
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()
        last = known[0] if known else 0
        held = {m[0]: tuple(m) for m in self.messages.get()}
        for batch in rows:
            last = max(last, int(batch["moment"].max()))
            for turn, role, text in batch[["turn", "role", "text"]].itertuples(index=False):
                held[int(turn)] = (int(turn), role, text)
            held = {turn: held[turn] for turn in sorted(held)[-self.window :]}
        if known and known[0] != last:
            self.handle.deleteTimer(known[0] + self.ttl_ms)
        self.handle.registerTimer(last + self.ttl_ms)
        self.last.update((last,))
        self.messages.put(list(held.values()))
        yield pd.DataFrame([(key[0], *m) for m in held.values()], columns=["session_id", "turn", "role", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.messages.clear()
        self.last.clear()
        gone = {"session_id": [key[0]], "turn": [None], "role": [None], "text": [None]}
        yield pd.DataFrame(gone).astype({"turn": "Int64"})

    def close(self) -> None:
        pass


def expiring_memory(messages: DataFrame, window: int = CONTEXT_WINDOW, ttl_seconds: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """For each changed session its newest messages, and one row without a turn for a session that has expired by event time."""
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("session_id", "turn", "role", "text", "ts", F.unix_millis("ts").alias("moment"))
    return rows.groupBy("session_id").transformWithStateInPandas(ExpiringMessages(window, ttl_seconds), MEMORY, "Update", "EventTime")


def keep_memory(changes: DataFrame, table: Table, checkpoint: str):
    """Keeps ``table`` (by ``session_id``) at one set of rows a session; an expired one has none.

    A session that has messages and expires in one batch has both kinds of rows and is gone.
    """

    def apply(batch: DataFrame, _: int) -> None:
        rows = written(batch, "memory")
        keys = rows.select("session_id").distinct()
        gone = rows.where("turn is null").select("session_id")
        table.replace(rows.join(gone, "session_id", "left_anti").select("session_id", "turn", "role", "text"), keys)

    return changes.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
