"""Snapshots, stored tables, ingestion and ledger on small fixtures."""

import datetime as dt
import os
import zlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from corpuscle.operators import jobs as J
from corpuscle.operators import quality as Q
from corpuscle.operators import sessions as SE
from corpuscle.operators import snapshots as D
from corpuscle.operators import tables
from corpuscle.operators.ranking import attach, spread_row_number
from corpuscle.plans import ingest
from corpuscle.sources import files as SF
from corpuscle.sources.store import Table

def now():
    return F.lit("2024-01-01").cast("timestamp")


def snap(spark, rows):
    return spark.createDataFrame(rows, "repo_id string, path string, content string")


def as_set(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_diff_kinds(spark):
    a = snap(spark, [("r", "same", "1"), ("r", "mod", "2"), ("r", "gone", "3"), ("r", "old", "4"), ("q", "same", "1")])
    b = snap(spark, [("r", "same", "1"), ("r", "mod", "x"), ("r", "new", "5"), ("r", "moved", "4"), ("q", "same", "1")])
    assert as_set(D.diff(a, b), "path", "status", "old_path") == {
        ("mod", "M", None), ("gone", "D", None), ("new", "A", None), ("moved", "R", "old")
    }
    assert D.diff(a, a).count() == 0


def test_diff_with_a_hot_content(spark):
    """Hundreds of copies of one content are paired one to one and none is lost."""
    a = snap(spark, [("r", f"a{i}", "") for i in range(300)])
    b = snap(spark, [("r", f"b{i}", "") for i in range(200)])
    changes = D.diff(a, b).cache()
    assert {r.status: r["count"] for r in changes.groupBy("status").count().collect()} == {"R": 200, "D": 100}
    assert changes.where("status = 'R'").select("old_path").distinct().count() == 200


def test_apply_diff_gives_the_new_snapshot(spark):
    a = snap(spark, [("r", f"p{i}", str(i)) for i in range(30)])
    b = snap(spark, [("r", f"p{i}" if i % 3 else f"n{i}", str(i) if i % 4 else "changed") for i in range(5, 40)])
    changes = D.diff(a, b)
    stored = a.withColumnRenamed("path", "file_path")
    new = b.join(D.to_process(changes).select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    result = D.apply_deletes(stored, changes).unionByName(new.withColumnRenamed("path", "file_path"))
    assert as_set(result, "repo_id", "file_path", "content") == as_set(b, "repo_id", "path", "content")
    assert result.count() == b.count()


def test_row_numbers(spark):
    df = spark.createDataFrame([("g", f"k{i}") for i in range(500)] + [("h", "x")], "g string, k string")
    got = spread_row_number(df, ["g"], "k")
    assert sorted(r.nth for r in got.where("g = 'g'").collect()) == list(range(1, 501))


def test_attach_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr("corpuscle.operators.ranking.BROADCAST_ROWS", 1)
    rows = spark.createDataFrame([("a", str(i)) for i in range(50)] + [("c", "z")], "k string, s string")
    details = spark.createDataFrame([("a", 1), ("b", 2)], "k string, d int")
    got = attach(rows, details, "k", "s")
    assert got.count() == 51 and got.where("d = 1").count() == 50


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t"), "repo_id string, file_path string, id int, v string", ["repo_id", "file_path"], 3)


def rows(spark, data):
    return spark.createDataFrame(data, "repo_id string, file_path string, id int, v string")


def test_table_upsert_delete(spark, table):
    assert table.read().count() == 0
    table.upsert(rows(spark, [("r", f"f{i}", i, "a") for i in range(20)]))
    table.upsert(rows(spark, [("r", "f3", 3, "b"), ("r", "new", 99, "b")]))
    assert table.read().count() == 21
    assert [r.v for r in table.lookup(repo_id="r", file_path="f3").collect()] == ["b"]
    before = as_set(table.read(), "file_path", "v")
    table.upsert(rows(spark, [("r", "f3", 3, "b")]))
    assert as_set(table.read(), "file_path", "v") == before
    with pytest.raises(ValueError, match="duplicate key"):
        table.upsert(rows(spark, [("r", "f3", 3, "c"), ("r", "f3", 4, "d")]))
    assert as_set(table.read(), "file_path", "v") == before
    table.delete(rows(spark, [("r", f"f{i}", 0, "") for i in range(20)]).select("repo_id", "file_path"))
    assert as_set(table.read(), "file_path") == {("new",)}


def test_table_delete_where_and_clear(spark, table):
    table.upsert(rows(spark, [("r", "f1", 1, "a"), ("q", "f2", 2, "a"), ("r", "f3", 3, None)]))
    table.delete_where({})
    assert table.read().count() == 3
    table.delete_where({"v": "a", "repo_id": "r"})
    assert as_set(table.read(), "file_path") == {("f2",), ("f3",)}
    assert table.clear() == 2 and table.read().count() == 0 and table.clear() == 0


def test_keys_hold_the_repository(spark):
    stored = spark.createDataFrame([("r", "1", "a"), ("q", "1", "b"), ("q", "2", "c")], "repo_id string, id string, content string")
    one = spark.createDataFrame([("q", "1")], "repo_id string, id string")
    assert as_set(tables.get_documents(stored, one), "content") == {("b",)}
    assert as_set(tables.get_documents(stored, one.select("id")), "content") == {("a",), ("b",)}
    assert as_set(tables.delete_ids(stored, one), "content") == {("a",), ("c",)}
    new = spark.createDataFrame([("q", "1", "x")], stored.schema)
    assert as_set(tables.upsert(stored, new, ["repo_id", "id"]), "content") == {("a",), ("c",), ("x",)}
    with pytest.raises(Exception, match="duplicate id"):
        tables.upsert(stored, new.unionByName(new), ["repo_id", "id"]).collect()


CODE = "// adds\nfunction add(a, b) {\n  return a + b;\n}\n"


def test_ingest(spark, tmp_path):
    corpus = ingest.Corpus(spark, str(tmp_path), buckets=2)
    first = snap(spark, [("r", "a.js", CODE), ("r", "b.py", "def f():\n    pass\n"), ("r", "x.png", "zz"), ("r", "n.txt", "note\x00")])
    owner = spark.createDataFrame([("r", "user-abc-123", '{"team":"backend","priority":1,"id":"hacked","list":[1]}')], "repo_id string, user_id string, meta string")
    ingest.run(corpus, first, now(), owner)
    chunk = corpus.chunks.read().where("file_path = 'a.js'").first()
    assert chunk.id == "a.js:add:function_declaration:L1" and chunk.function_name == "add"
    assert (chunk.category, chunk.workspace_id, chunk.user_id, chunk.timestamp) == ("repository", "workspace", "user-abc-123", "2024-01-01T00:00:00.000Z")
    assert (chunk.file_type, chunk.chunk_index, chunk.parent_id, chunk.repository_id, chunk.start_line, chunk.end_line) == (".js", 0, "a.js", "r", 1, 4)
    assert chunk.meta == {"team": '"backend"', "priority": "1"} and len(chunk.vector) == 64
    assert as_set(corpus.parents.read(), "id", "content") == {("a.js", CODE), ("b.py", "def f():\n    pass\n"), ("n.txt", "note")}

    again = ingest.run(corpus, first, now(), owner)
    assert again.count() == 0
    second = snap(spark, [("r", "c.js", CODE), ("r", "b.py", "def g():\n    pass\n"), ("r", "n.txt", "note\x00")])
    changes = ingest.run(corpus, second, now(), owner)
    assert as_set(changes, "path", "status") == {("c.js", "R"), ("b.py", "M"), ("x.png", "D")}
    assert as_set(corpus.chunks.read(), "id") == {("c.js:add:function_declaration:L1",), ("b.py:g:function_definition:L1",)}
    assert as_set(corpus.parents.read(), "id") == {("c.js",), ("b.py",), ("n.txt",)}
    ingest.run(corpus, second.where("path = 'c.js'"), now(), owner)
    assert as_set(corpus.parents.read(), "id") == {("c.js",)}
    other = snap(spark, [("q", "a.js", CODE)])
    ingest.run(corpus, other, now())
    assert as_set(corpus.parents.read(), "repo_id", "id") == {("r", "c.js"), ("q", "a.js")}
    changes = ingest.run(corpus, other, now(), repos=spark.createDataFrame([("r",), ("q",)], "repo_id string"))
    assert as_set(changes, "repo_id", "path", "status") == {("r", "c.js", "D")}
    assert as_set(corpus.parents.read(), "repo_id", "id") == {("q", "a.js")}
    assert as_set(corpus.chunks.read(), "repo_id") == {("q",)}


def test_scan_files(spark, tmp_path):
    root = tmp_path / "repo"
    os.makedirs(root / "src")
    (root / "src" / "a.ts").write_bytes(b"let x = 1;\xff")
    (root / "logo.png").write_bytes(b"\x89PNG")
    (root / "README").write_text("hi")
    got = as_set(SF.scan_files(spark, str(root), "r"), "repo_id", "path", "content")
    assert got == {("r", "src/a.ts", "let x = 1;�"), ("r", "README", "hi")}
    assert SF.list_files(spark, str(root), "r").count() == 3


def test_scan_files_lists_in_tasks(spark, tmp_path, monkeypatch):
    """The driver holds no file names, folders are dealt out in rounds, and the rows are those of Spark's reader."""
    monkeypatch.setattr(SF, "_ENTRIES", 3)
    monkeypatch.setattr(SF, "_BATCH_BYTES", 64)
    root = tmp_path / "a b%20#1"
    names = [f"d{n % 5}/e{n % 3}/f{n % 2}/{n}.txt" for n in range(60)]
    names += ["_x", "_x=1", ".x", "x._COPYING_", "_metadata", "_d/x.txt", ".d/x.txt", "_d=1/x.txt", "n\nl.txt", "[q]?.txt", "é.md", "sub.png/in.txt"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"in {name}", newline="")
    (root / "long.txt").write_text("long " * 100)
    (root / "none.txt").write_bytes(b"")
    (root / "void").mkdir()
    (root / "link.txt").symlink_to("long.txt")
    (root / "gone.txt").symlink_to("nowhere")
    (root / "linked").symlink_to("d1/e1")
    for name, data in {"good.txt": b"12345678", "bad.txt": b"12345679"}.items():
        (root / name).write_bytes(data)
        (root / f".{name}.crc").write_bytes(b"crc\0" + (5).to_bytes(4) + zlib.crc32(b"12345").to_bytes(4) + zlib.crc32(b"678").to_bytes(4))

    def spark_reads(glob):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
        found = reader.option("pathGlobFilter", glob).load(str(root)).select("path", "content").collect()
        return sorted((r.path.removeprefix(f"file:{root}/"), r.content.decode()) for r in found)

    for glob, where in (("*", str(root)), ("*.txt", f"file://{root}"), ("{1,[2-4]}*.t?t", f"{root}/"), ("nothing", str(root))):
        got = SF.scan_files(spark, where, "r", glob).select("path", "content").collect()
        assert sorted((r.path, r.content) for r in got) == spark_reads(glob), glob
    found = SF.scan_files(spark, str(root), "r")
    assert found.count() > 60 and not [f for f in found.inputFiles() if "/a%20b" in f]
    assert SF.scan_files(spark, str(root / "void"), "r").count() == 0
    local = fs.LocalFileSystem()  # seen through another store, folders are listed alike
    assert set(SF._entries(fs.SubTreeFileSystem(str(root), local), "d1")) == set(SF._entries(local, f"{root}/d1")) != set()
    assert set(SF._entries(local, f"{root}/d1/e1/f1")) == {("1.txt", 17), ("31.txt", 18)}
    assert as_set(SF.scan_files(spark, str(root / "lo*.txt"), "r"), "content") == {("long " * 100,)}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        SF.scan_files(spark, str(root / "missing"), "r")


def test_write_files(spark, tmp_path):
    """A file a row, in folders named as Spark names them, and without a process or checksum a file."""
    rows = [("a", "x"), ("a", "x"), ("b:1", "y\nz"), (None, "é"), ("", None)]
    docs = spark.createDataFrame(rows, "source string, text string")
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    docs.write.partitionBy("source").option("maxRecordsPerFile", 1).text(old)
    assert SF.write_files(docs, new, "source", "text") == 5

    def read(root):
        found = SF.scan_files(spark, root, "r", "*.txt").select(F.regexp_replace("path", "/[^/]+$", ""), "content")
        return sorted(tuple(r) for r in found.collect())

    assert read(new) == read(old) and len(read(new)) == 5
    assert not [f for _, _, names in os.walk(new) for f in names if not f.endswith(".txt")]
    assert SF.write_files(docs.where("false"), str(tmp_path / "none"), "source", "text") == 0
    assert read(str(tmp_path / "none")) == []


def test_quality(spark):
    df = spark.createDataFrame([("r", "f", "a", "x"), ("r", "f", "a", " "), ("r", "f", "b", "y")], "repo_id string, file_path string, id string, content string")
    assert as_set(Q.duplicate_ids(df, ["id"]), "id", "copies") == {("a", 2)}
    assert Q.duplicate_summary(df, ["id"]).first().asDict() == {"total": 3, "unique_ids": 2, "duplicates": 1}
    counts = Q.chunk_counts(df).first()
    assert (counts.extracted, counts.valid, counts.dropped, counts.unique_ids) == (3, 2, 1, 2)
    with pytest.raises(Exception, match="duplicate id: a"):
        Q.require_unique(df, ["id"]).collect()


def test_ledger(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    events = spark.createDataFrame(
        [("a", t(0), 1, "queued", None), ("a", t(1), 2, "failed", "boom"), ("b", t(0), 3, "queued", None),
         ("b", t(2), 4, "completed", None), ("c", t(0), 5, "failed", None), ("c", t(1), 6, "failed", None), ("c", t(2), 7, "failed", None)],
        "job_id string, ts timestamp, event_id int, state string, reason string",
    )
    assert as_set(J.status(events), "job_id", "state", "progress") == {("a", "failed", 0), ("b", "completed", 100), ("c", "failed", 0)}
    assert as_set(J.failed(events), "job_id", "failed_reason", "total_failed") == {("a", "boom", 2), ("c", "Unknown error", 2)}
    assert as_set(J.retry_schedule(events), "job_id", "next_attempt") == {("a", dt.datetime(2024, 1, 1, 0, 1, 5)), ("c", None)}
    asked = spark.createDataFrame([("a",), ("b",), ("zz",)], "job_id string")
    assert as_set(J.retry_outcome(events, asked), "job_id", "outcome") == {("a", "requeued"), ("b", "not failed: completed"), ("zz", "not found")}
    requeued = J.retry(events, asked, F.lit("2024-01-02").cast("timestamp"))
    assert as_set(requeued, "job_id") == {("a",)}


def test_sessions_with_a_busy_user(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base + dt.timedelta(seconds=s)) for s in [*range(0, 600), 4198, 7799, 7800]] + [(2, base)]
    got = SE.sessionize(spark.createDataFrame(rows, "user_id int, ts timestamp"), 3600)
    assert as_set(got, "user_id", "message_count") == {(1, 601), (1, 2), (2, 1)}
