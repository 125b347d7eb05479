"""Expressions on fixed inputs."""

import re

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import chat, meta, moment, path, text, url, validate
from corpuscle.operators import search as S


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


PREP = [
    ("text\nwith\nnewlines", "text with newlines"),
    ("  text with spaces  ", "text with spaces"),
    ("  \ntext\n with\n newlines\n  ", "text  with  newlines"),
    ("\n", " "),
    ("\na", " a"),
    ("a\n", "a "),
    ("\n\na\n\n", "a"),
    ("a\r\nb\t", "a\r b"),
    (" 　a﻿", "a"),
    ("   ", ""),
    ("Text with émojis 🎉 and spëcial çhars!", "Text with émojis 🎉 and spëcial çhars!"),
    (None, None),
]


def test_embed_prep(spark):
    assert values(spark, [p[0] for p in PREP], text.embed_prep) == [p[1] for p in PREP]


def js_prep(s):
    """What one pass of /^\\s+|\\s+$|\\n/g with a callback does."""
    white = "\t\n\x0b\f\r                  　﻿"
    w = f"[{re.escape(white)}]"
    return re.sub(rf"\A{w}+|{w}+\Z|\n", lambda m: " " if m[0] == "\n" else "", s)


def test_embed_prep_against_emulation(spark):
    import itertools

    inputs = ["".join(c) for n in range(5) for c in itertools.product("\n a\t", repeat=n)]
    assert values(spark, inputs, text.embed_prep) == [js_prep(s) for s in inputs]


def test_tokens(spark):
    assert values(spark, ["", "a", "abcd", "abcde"], text.estimate_tokens) == [0, 1, 1, 2]
    assert [len(v) for v in values(spark, ["a" * 40000, "a" * 32000, "b"], text.truncate_tokens)] == [32000, 32000, 1]


def test_sanitize(spark):
    assert values(spark, ["a\x00b\x01\x7fc\t\n\r"], text.sanitize) == ["abc\t\n\r"]


@pytest.mark.parametrize(
    "address,expected",
    [
        ("https://github.com/org/my-awesome-repo.git", "my-awesome-repo"),
        ("https://github.com/org/my_repo_name.git", "my_repo_name"),
        ("https://github.com/org/repo.name.git", "repo.name"),
        ("https://gitlab.com/group/subgroup/project.git", "project"),
        ("https://github.com/org/repo/", "repo"),
        ("https://github.com/org/repo///", "repo"),
        ("git@github.com:org/repo.git", "repo"),
        ("not-a-valid-url", None),
        ("https://github.com/org/repo<name>.git", None),
    ],
)
def test_repo_id(spark, address, expected):
    assert values(spark, [address], url.repo_id) == [expected]


def test_paths(spark):
    names = ["a/b.TS", ".gitignore", "Makefile", "a.b/Makefile", "x.tar.gz", "d/.env.local"]
    assert values(spark, names, path.file_type) == [".TS", "", "", "", ".gz", ".local"]
    assert values(spark, names, path.last_dot_suffix) == [".ts", ".gitignore", "makefile", ".b/makefile", ".gz", ".local"]
    assert values(spark, ["a.PNG", "yarn.lock", "logo.svg", "a.ts"], path.is_binary_path) == [True, True, True, False]
    assert len(path.BINARY_EXTENSIONS) == 52


def test_meta_sanitize(spark):
    bodies = [
        '{"team":"backend","project":"api","priority":1}',
        '{"validString":"value","validNumber":42,"validBoolean":true,"invalidObject":{"nested":"value"},"invalidArray":[1,2,3]}',
        '{"category":"hacked","id":"hacked-id","repositoryId":"hacked-repo","customField":"allowed"}',
        None,
        "[1]",
    ]
    clean = values(spark, bodies, lambda x: F.to_json(F.transform_values(meta.sanitize(meta.variant_map(x)), lambda _, v: F.to_json(v))))
    assert clean[0] == '{"team":"\\"backend\\"","project":"\\"api\\"","priority":"1"}' or '"priority":"1"' in clean[0]
    assert "invalid" not in clean[1] and '"validNumber":"42"' in clean[1] and '"validBoolean":"true"' in clean[1]
    assert clean[2] == '{"customField":"\\"allowed\\""}'
    assert clean[3:] == ["{}", "{}"]


def test_flat(spark):
    bodies = ['{"a":"x","b":1,"c":true}', "{}", None, '{"a":{"b":1}}', '{"a":[1]}', "[1]", '{"a":null}', "bad"]
    assert values(spark, bodies, meta.is_flat) == [True, True, True, False, False, False, False, False]


def test_merge_later_wins(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS x, map('b', 3) AS y, map('c', 4, 'a', 5) AS z")
    assert df.select(meta.merge(F.col("x"), F.col("y"), F.col("z"))).first()[0] == {"a": 5, "b": 3, "c": 4}


def test_iso(spark):
    out = values(spark, ["2024-03-01 10:00:00.1234"], lambda x: moment.iso8601(x.cast("timestamp")))
    assert out == ["2024-03-01T10:00:00.123Z"]


@pytest.mark.parametrize(
    "prompt,k,body,expected",
    [
        ("find", 10.0, None, []),
        ("", None, "{}", []),
        (None, None, None, ["prompt"]),
        ("p", 0.0, None, ["k"]),
        ("p", 101.0, None, ["k"]),
        ("p", 5.5, '{"a":[1]}', ["k", "meta"]),
    ],
)
def test_search_request(spark, prompt, k, body, expected):
    df = spark.createDataFrame([(prompt, k, body)], "p string, k double, m string")
    assert df.select(validate.search_request(F.col("p"), F.col("k"), F.col("m"))).first()[0] == expected


@pytest.mark.parametrize(
    "address,ok",
    [
        ("https://github.com/user/repo.git", True),
        ("http://gitlab.com/a", True),
        ("invalid-url", False),
        ("", False),
        (None, False),
        ("ftp://a.org/b", False),
        ("https://localhost/x", False),
        ("https://github.com/a<b>", False),
        ("https://10.0.0.1:8080/x.git", True),
    ],
)
def test_http_url(spark, address, ok):
    assert values(spark, [address], url.is_http_url) == [ok]


def test_git_url(spark):
    good = ["https://github.com/a/b", "HTTP://x.org/a.git", "https://u@gitlab.com:8080/a", "https://github.com/o/r<n>.git"]
    bad = ["https://x.org/a", "https://x.org/a.git?x=1", "git@github.com:a/b.git", "ftp://github.com/a.git", "https:///a.git", None]
    assert values(spark, good + bad, url.is_git_url) == [True] * len(good) + [False] * len(bad)


def test_unknown_fields(spark):
    df = spark.createDataFrame([('{"prompt":"a"}',), ('{"prompt":"a","x":1}',)], "b string")
    assert [r[0] for r in df.select(validate.json_request(df, "b", ["prompt", "k", "meta"])).collect()] == [[], ["unknown"]]


def test_normalize_k(spark):
    assert values(spark, [None, 0.0, -1.0, 2.5, 1.0, 100.0, 500.0], S.normalize_k, "double") == [5, 5, 5, 5, 1, 100, 100]


def test_route(spark):
    assert values(spark, ["gpt-4", "GPT-4o", "Claude-3", "other"], chat.route) == ["openai", "openai", "anthropic", None]


def test_generate_and_context(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "query_id int, rank int, content string")
    packed = {r.query_id: r.context for r in chat.context_pack(df, "|").collect()}
    assert packed == {1: "a|b", 2: "c"}

    def load():
        return lambda bodies: [b.upper() for b in bodies]

    answers = chat.generate(df.withColumnRenamed("content", "request"), load)
    assert {r.answer for r in answers.collect()} == {"A", "B", "C"}


def test_time_is_utc_in_any_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert spark.range(1).select(moment.iso8601(F.timestamp_seconds(F.lit(0)))).first()[0] == "1970-01-01T00:00:00.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_words_of_long_texts_are_all_embedded(spark):
    from corpuscle.operators import embed

    rows = embed.embed(spark.createDataFrame([("a " * 20000 + "b",), ("a " * 20000,)], "content string")).collect()
    assert rows[0].vector != rows[1].vector


def test_a_file_without_content_is_there(spark):
    from corpuscle.operators import snapshots

    kind = "repo_id string, path string, content string"
    before = spark.createDataFrame([("r", "p", "x")], kind)
    after = spark.createDataFrame([("r", "p", None), ("r", "q", None)], kind)
    assert sorted((c.path, c.status) for c in snapshots.diff(before, after).collect()) == [("p", "M"), ("q", "A")]
