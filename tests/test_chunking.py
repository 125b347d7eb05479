"""Code chunks of one small file per language: names, node types and line ranges."""

import re

import pytest

from corpuscle.operators.chunking import languages, prose
from corpuscle.operators.chunking.blocks import code_chunks
from corpuscle.operators.chunking.rules import LANGUAGES
from corpuscle.plans.code_samples import SAMPLES as CASES
from corpuscle.plans.ingest import chunk_files

@pytest.fixture(scope="module")
def chunks(spark):
    files = spark.createDataFrame([("r", p, c) for p, (c, _) in CASES.items()], "repo_id string, path string, content string")
    found = {}
    for r in code_chunks(files).orderBy("file_path", "chunk_index").collect():
        found.setdefault(r.file_path, []).append(r)
    return found


@pytest.mark.parametrize("path", list(CASES))
def test_chunks(chunks, path):
    got = chunks.get(path, [])
    assert [(r.name, r.chunk_type, r.start_line, r.end_line) for r in got] == CASES[path][1]
    assert [r.chunk_index for r in got] == list(range(len(got)))
    assert all(re.fullmatch(re.escape(f"{path}:{r.name}:{r.chunk_type}:L{r.start_line}") + r"(#\d+)?", r.id) for r in got)
    assert len({r.id for r in got}) == len(got)
    assert all(r.content in CASES[path][0] for r in got)


def test_every_language_has_rules_and_a_case():
    assert set(LANGUAGES) == set(languages.EXTENSIONS) and len(LANGUAGES) == 35
    assert sum(len(e) for e in languages.EXTENSIONS.values()) == 73


def test_detect(spark):
    names = ["a.TS", "b.tsx", "c.PY", "d.h", "e.unknown", "Makefile", ".gitignore", "x/y.hpp"]
    found = languages.detect(spark.createDataFrame([(n,) for n in names], "path string"))
    assert {r.path: r.language for r in found.collect()} == {
        "a.TS": "typescript", "b.tsx": "tsx", "c.PY": "python", "d.h": "c", "e.unknown": None, "Makefile": None,
        ".gitignore": None, "x/y.hpp": "cpp",
    }
    assert languages.by_language(spark).count() == 35


def test_equal_blocks_are_numbered(spark):
    """Several anonymous objects on one line share all but the ordinal."""
    files = spark.createDataFrame([("a.json", '{"a": {}, "b": {"c": {}}}')], "path string, content string")
    ids = [r.id for r in code_chunks(files).where("chunk_type = 'object'").orderBy("chunk_index").collect()]
    assert ids == ["a.json:anonymous:object:L1" + end for end in ("", "#2", "#3", "#4")]
    assert code_chunks(files).count() == 7


def test_long_texts_of_any_shape(spark):
    """No prefix, no recursion limit: units of a million characters pass."""
    prose = "word " * 200000
    files = [("a.java", prose), ("a.py", prose), ("a.md", prose), ("a.ts", "(" * 100000), ("b.ts", '"' * 99999 + prose),
             ("c.ts", prose + ";\nclass Last {\n}\n")]
    found = code_chunks(spark.createDataFrame(files, "path string, content string")).collect()
    assert {(r.file_path, r.chunk_type) for r in found} == {("a.md", "section"), ("c.ts", "class_declaration")}


def test_offsets_count_bytes_not_characters(spark):
    text = "// é🎉 comment\nclass A {\n  /* ü */ run() { return 'ß{'; }\n}\n"
    got = code_chunks(spark.createDataFrame([("a.js", text)], "path string, content string")).orderBy("chunk_index").collect()
    assert [r.content for r in got] == [text.strip(), "/* ü */ run() { return 'ß{'; }"]


def test_ingestion_keeps_every_block_of_a_line(spark):
    """Blocks of equal line, type and name are told apart by an ordinal."""
    files = spark.createDataFrame([("r", "a.json", '{"a": {}, "b": {"c": {}}}')], "repo_id string, path string, content string")
    got = chunk_files(files).orderBy("chunk_index").collect()
    assert len(got) == len({r.id for r in got}) == 7
    objects = [(r.id, r.content) for r in got if r.chunk_type == "object"]
    assert [i for i, _ in objects] == ["a.json:anonymous:object:L1" + end for end in ("", "#2", "#3", "#4")]
    assert [c for _, c in objects] == ['{"a": {}, "b": {"c": {}}}', "{}", '{"c": {}}', "{}"]


PROSE = (
    "# One #\nplain\n  more\n\n- a\n  goes on\n\t* b\n12. c\ntext\n| x | y |\n|---|---|\n## \n~~~\n```\n# no\n~~~\n```\n~~~\nopen\n\n"
    "####### seven\n#tag\n-no\n"
)


def test_prose_blocks(spark):
    docs = spark.createDataFrame([("r", "p.md", PROSE), ("r", "e.md", ""), ("r", "n.md", None), ("r", "b.md", " \n\t"), ("r", "f.md", "~~~")], "repo_id string, id string, content string")
    got = prose.prose_blocks(docs).orderBy("file_path", "chunk_index").collect()
    assert [(r.chunk_type, r.name, r.start_line, r.end_line) for r in got if r.file_path == "p.md"] == [
        ("heading", "One", 1, 1), ("paragraph", "anonymous", 2, 3), ("list", "anonymous", 5, 8), ("paragraph", "anonymous", 9, 9),
        ("table", "anonymous", 10, 11), ("heading", "anonymous", 12, 12), ("code_block", "anonymous", 13, 16), ("code_block", "anonymous", 17, 24),
    ]
    lines = PROSE.split("\n")
    assert all(r.content == "\n".join(lines[r.start_line - 1 : r.end_line]) for r in got if r.file_path == "p.md")
    assert [(r.id, r.content) for r in got if r.file_path != "p.md"] == [("f.md:anonymous:code_block:L1", "~~~")]
    assert len({r.id for r in got}) == len(got)


def test_prose_of_a_long_document(spark):
    text = "\n".join(["- item", "  on", "", "word " * 50] * 30_000)
    got = prose.prose_blocks(spark.createDataFrame([("p.md", text)], "id string, content string"))
    assert got.groupBy("chunk_type").count().collect() and got.count() == 60_000


def test_layout_and_nesting_hold_little():
    """What a batch holds beside its rows is bounded, however many files it has, and equals file by file."""
    import tracemalloc

    import pyarrow as pa

    from corpuscle.operators.chunking import blocks, nesting

    text = "function f(a, {b: 1}) { return [1, 2, {c: (d)}]; }\n" * 45
    files = pa.array([text, None, "é" + text] * 700)
    names = pa.array(["typescript"] * len(files))
    tracemalloc.start()
    found = nesting.nested.func(files, names)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert found.to_pylist()[:3] == nesting.nested.func(files[:3], names[:3]).to_pylist()
    assert found[1].as_py() is None and found[0].as_py().encode() == nesting.hide([text.encode()], ["typescript"])[0]

    ints = pa.list_(pa.int32())
    columns = [
        pa.array([[3, 2, 4], [], [5, 6]], ints), pa.array([[1, 1, 0], [], [0, 1]], ints), pa.array([[0, 2, 0], [], [0, 0]], ints),
        pa.array([[1, 0, -1], [], [0, 1]], ints), pa.array([None, [], [0, 1]], ints), pa.array([["a", "", "a"], None, None], pa.list_(pa.string())),
    ]
    whole = blocks._layout.func(*columns).to_pylist()
    assert whole == [blocks._layout.func(*[c[i : i + 1] for c in columns]).to_pylist()[0] for i in range(3)]
    assert whole[0] == {"off": [0, 3, 5], "line": [1, 2, 3], "ctx": [0, 1, 1], "prev": [-1, 0, 0], "close": [2, 1, 2], "wide": [2, 1, 2]}
    assert whole[1] == {name: [] for name in blocks._LAYOUT}
