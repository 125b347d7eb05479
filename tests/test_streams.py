"""Streams over several micro-batches: late and repeated versions, renames, replays, open sessions, expiry."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corpuscle import schemas
from corpuscle.plans import ingest
from corpuscle.plans.corpus_queries import ROCKSDB
from corpuscle.sources.store import Table
from corpuscle.streaming import changes as SC
from corpuscle.streaming import sessions as SS

EVENTS = "repo_id string, path string, version long, op string, content string, old_path string"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Feed:
    """A folder that grows, and runs of a stream over it from one checkpoint."""

    def __init__(self, spark, place, schema):
        self.spark, self.root, self.checkpoint, self.schema = spark, f"{place}/in", f"{place}/checkpoint", schema

    def run(self, rows, writer):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.root)
        self.again(writer)

    def again(self, writer):
        kind = self.spark.createDataFrame([], self.schema).schema
        writer(self.spark.readStream.schema(kind).parquet(self.root), self.checkpoint).start().awaitTermination()


def stored(corpus):
    return sorted((r.repo_id, r.file_path, r.content) for r in corpus.chunks.read().collect())


def test_changes_of_files(spark, tmp_path):
    corpus = ingest.Corpus(spark, str(tmp_path / "corpus"), buckets=2)
    feed, now = Feed(spark, tmp_path, EVENTS), F.lit("2024-01-01").cast("timestamp")
    write = lambda rows, place: SC.ingest_changes(rows, corpus, place, now, prose_too=True)
    feed.run(
        [
            ("r", "a.txt", 1, "update", "a one", None), ("r", "a.txt", 3, "update", "a three", None), ("r", "a.txt", 2, "update", "a two", None),
            ("r", "b.txt", 1, "update", "b", None), ("r", "c.txt", 1, "update", "c", None), ("s", "a.txt", 1, "update", "other", None),
            ("r", "n.txt", None, "update", "no version", None), ("r", "e.txt", 1, "update", None, None),
        ],
        write,
    )
    assert stored(corpus) == [("r", "a.txt", "a three"), ("r", "b.txt", "b"), ("r", "c.txt", "c"), ("r", "n.txt", "no version"), ("s", "a.txt", "other")]
    feed.run(
        [
            ("r", "a.txt", 2, "update", "late", None), ("r", "b.txt", 2, "delete", None, None), ("r", "d.txt", 2, "rename", "c moved", "c.txt"),
            ("s", "a.txt", 2, "rename", "swapped", "x.txt"), ("s", "x.txt", 2, "rename", "other", "a.txt"), ("r", "n.txt", 0, "update", "known", None),
        ],
        write,
    )
    after = [("r", "a.txt", "a three"), ("r", "d.txt", "c moved"), ("r", "n.txt", "known"), ("s", "a.txt", "swapped"), ("s", "x.txt", "other")]
    assert stored(corpus) == after
    feed.run([("r", "b.txt", 1, "update", "dead", None), ("r", "c.txt", 2, "update", "dead", None), ("r", "b.txt", 2, "update", "dead", None)], write)
    assert stored(corpus) == after
    assert sorted(r.path for r in corpus.signatures.read().where("repo_id = 'r'").collect()) == ["a.txt", "d.txt", "e.txt", "n.txt"]
    assert {r.id for r in corpus.parents.read().where("repo_id = 's'").collect()} == {"a.txt", "x.txt"}


def test_replay_of_a_batch_that_died_between_tables(spark, tmp_path, monkeypatch):
    corpus = ingest.Corpus(spark, str(tmp_path / "corpus"), buckets=2)
    feed, now = Feed(spark, tmp_path, EVENTS), F.lit("2024-01-01").cast("timestamp")
    write = lambda rows, place: SC.ingest_changes(rows, corpus, place, now, prose_too=True)
    feed.run([("r", "a.txt", 1, "update", "a", None), ("r", "b.txt", 1, "update", "b", None)], write)

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus.signatures, "replace", dies)
    second = [("r", "a.txt", 2, "update", "a two", None), ("r", "b.txt", 2, "delete", None, None)]
    with pytest.raises(StreamingQueryException):
        feed.run(second, write)
    assert {r.batch for r in corpus.commits.read().collect()} == {0}
    monkeypatch.undo()
    feed.again(write)
    assert stored(corpus) == [("r", "a.txt", "a two")]
    assert {r.path for r in corpus.signatures.read().collect()} == {"a.txt"} and {r.batch for r in corpus.commits.read().collect()} == {1}


def test_a_committed_batch_is_not_applied_again(spark, tmp_path):
    commits, applied = Table(spark, str(tmp_path / "commits"), schemas.COMMITS, ["stream"], 2), []
    assert SC.once(commits, "s", 0, lambda: applied.append(0)) and SC.once(commits, "t", 5, lambda: applied.append(5))
    assert not SC.once(commits, "s", 0, lambda: applied.append("again")) and SC.once(commits, "s", 1, lambda: applied.append(1))
    assert applied == [0, 5, 1] and {(r.stream, r.batch) for r in commits.read().collect()} == {("s", 1), ("t", 5)}


def at(minute):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_open_sessions_grow_join_and_close(spark, tmp_path):
    table = Table(spark, str(tmp_path / "sessions"), schemas.OPEN_SESSIONS, ["user_id", "created_at"], 2)
    feed = Feed(spark, tmp_path, "user_id long, event_id long, ts timestamp")
    write = lambda rows, place: SS.keep_sessions(SS.open_sessions(rows, 3600, "2 hours"), table, place)
    state = lambda: sorted((r.user_id, r.created_at, r.last_accessed_at, r.message_count, r.state) for r in table.read().collect())
    feed.run([(1, 1, at(0)), (1, 2, at(50)), (1, 3, at(140)), (2, 4, at(10)), (2, 4, at(10))], write)
    assert state() == [(1, at(0), at(50), 2, "open"), (1, at(140), at(140), 1, "open"), (2, at(10), at(10), 1, "open")]
    feed.run([(1, 5, at(100)), (2, 6, at(69))], write)  # the late message joins two sessions
    assert state() == [(1, at(0), at(140), 4, "open"), (2, at(10), at(69), 2, "open")]
    feed.run([(3, 7, at(320))], write)  # the watermark is at 200
    assert state() == [(1, at(0), at(140), 4, "closed"), (2, at(10), at(69), 2, "closed"), (3, at(320), at(320), 1, "open")]
    feed.run([(1, 8, at(330))], write)
    assert (1, at(0), at(140), 4, "closed") in state() and (1, at(330), at(330), 1, "open") in state()


def test_silent_sessions_expire(spark, tmp_path):
    table = Table(spark, str(tmp_path / "memory"), SS.MEMORY, ["session_id"], 2)
    feed = Feed(spark, tmp_path, "session_id long, turn long, role string, text string, ts timestamp")
    write = lambda rows, place: SS.keep_memory(SS.expiring_memory(rows, 2, 3600, "10 minutes"), table, place)
    state = lambda: sorted((r.session_id, r.turn, r.text) for r in table.read().collect())
    feed.run([(1, 0, "user", "a", at(0)), (1, 1, "user", "b", at(1)), (1, 2, "user", "c", at(2)), (2, 0, "user", "x", at(3))], write)
    assert state() == [(1, 1, "b"), (1, 2, "c"), (2, 0, "x")]
    feed.run([(2, 1, "user", "y", at(60)), (2, 1, "user", "y", at(60))], write)
    assert state() == [(1, 1, "b"), (1, 2, "c"), (2, 0, "x"), (2, 1, "y")]
    feed.run([(3, 0, "user", "z", at(80))], write)  # the watermark is at 70: session 1 was silent since 2
    assert state() == [(2, 0, "x"), (2, 1, "y"), (3, 0, "z")]
    feed.run([(1, 3, "user", "new", at(90))], write)
    assert state() == [(1, 3, "new"), (2, 0, "x"), (2, 1, "y"), (3, 0, "z")]


def test_one_timer_closes_a_users_sessions():
    """A user has one timer, for the session that closes first, and it is set again for what is left."""
    from pyspark.sql import Row

    class Held:
        def __init__(self):
            self.rows, self.timers = [], []

        def getListState(self, *_):
            return self

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 150

    held, sessions = Held(), SS.OpenSessions(1)
    sessions.ttl_us = 50_000
    sessions.init(held)
    rows = [Row(event_id=n, moment=t) for n, t in enumerate([300_000, 90_000, 100_000, 0])] + [Row(event_id=3, moment=7)]
    out = [tuple(r) for r in sessions.handleInputRows((7,), iter(rows), Times())]
    assert out == [(7, 0, 0, 1, SS.OPEN), (7, 90_000, 100_000, 2, SS.OPEN), (7, 300_000, 300_000, 1, SS.OPEN)]
    assert held.timers == [50]
    assert [tuple(r)[1:] for r in sessions.handleExpiredTimer((7,), Times(), None)] == [(0, 0, 1, SS.CLOSED), (90_000, 100_000, 2, SS.CLOSED)]
    assert held.rows == [(300_000, 300_000, 1)] and held.timers == [50, 350]
