"""Search against brute force, with ties, blocks, skew and missing parents."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import approx as A
from corpuscle.operators import embed as E
from corpuscle.operators import filters as FL
from corpuscle.operators import keyword as K
from corpuscle.operators import search as S
from corpuscle.plans import retrieval as R
from corpuscle.plans import testbed as TB

SF = "/root/testdata/sf0.001"
KINDS = "id string, content string, parent_id string, repo_id string, vector array<float>"


def brute(corpus, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((float(sum((np.float64(a) - np.float64(b)) ** 2 for a, b in zip(x, v))), i) for i, x in corpus)
        out[q] = [i for _, i in scored[:k]]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of all vectors are copies of one."""
    rng = np.random.default_rng(7)
    rows = [(f"v{i:04d}", [0.5, 0.5, 0.5] if i % 3 == 0 else rng.random(3).astype(np.float32).tolist()) for i in range(900)]
    queries = [(f"q{i}", rng.random(3).astype(np.float32).tolist()) for i in range(20)] + [("q20", [0.5, 0.5, 0.5])]
    return rows, queries


def frames(spark, crowd):
    rows, queries = crowd
    return (
        spark.createDataFrame(rows, "id string, vector array<float>").repartition(7),
        spark.createDataFrame(queries, "query_id string, vector array<float>"),
    )


def test_exact_with_ties(spark, crowd):
    corpus, queries = frames(spark, crowd)
    assert ranked(S.similarity_search(corpus, queries, 12)) == brute(*crowd, 12)


def test_candidates_carry_no_payload(spark, crowd, monkeypatch):
    """Of many hits only what orders them leaves the scan; ids may repeat, and each hit gets its own row's payload."""
    rows, queries = crowd
    rows = [(f"v{int(i[1:]) // 2:03d}", f"r{int(i[1:]) % 2}", f"text {i}", v) for i, v in rows]
    corpus = spark.createDataFrame(rows, "id string, repo_id string, content string, vector array<float>").repartition(7)
    asked = spark.createDataFrame(queries, "query_id string, vector array<float>")
    scanned = []
    scan = S.topk.scan_topk
    monkeypatch.setattr(S.topk, "scan_topk", lambda part, *rest: scanned.append(part.columns) or scan(part, *rest))

    def found(**options):
        hits = S.similarity_search(corpus, asked, 12, payload=["repo_id", "content", "vector"], **options)
        return sorted((r.query_id, r["rank"], r.id, r.repo_id, r.content, tuple(r.vector), r.distance) for r in hits.collect())

    few = found()
    monkeypatch.setattr(S, "FEW_HITS", 10)
    scanned.clear()
    assert found() == few
    assert scanned == [["id", "repo_id", "_corpus_row", "vector"]]
    assert found(block_rows=5) == few


def test_many_query_blocks(spark, crowd):
    corpus, queries = frames(spark, crowd)
    assert ranked(S.similarity_search(corpus, queries, 4, block_rows=5)) == brute(*crowd, 4)


def test_prefix_and_monotone(spark, crowd):
    corpus, queries = frames(spark, crowd)
    short, long = ranked(S.similarity_search(corpus, queries, 3)), ranked(S.similarity_search(corpus, queries, 9))
    assert all(long[q][:3] == short[q] for q in short)
    scores = [r.score for r in S.similarity_search(corpus, queries.limit(1), 9).orderBy("rank").collect()]
    assert scores == sorted(scores, reverse=True)


def test_k_per_query(spark, crowd):
    corpus, queries = frames(spark, crowd)
    own = queries.withColumn("k", F.when(F.col("query_id") == "q1", 2.0).when(F.col("query_id") == "q2", 0.0))
    found = ranked(S.similarity_search(corpus, own))
    assert len(found["q1"]) == 2 and len(found["q2"]) == 5 and len(found["q3"]) == 5


def test_wrong_dimension_fails(spark, crowd):
    corpus, queries = frames(spark, crowd)
    bad = corpus.unionByName(spark.createDataFrame([("x", [1.0])], corpus.schema))
    with pytest.raises(Exception, match="dimensions"):
        S.similarity_search(bad, queries, 2).collect()


def test_no_queries(spark, crowd):
    corpus, queries = frames(spark, crowd)
    assert S.similarity_search(corpus, queries.where("false"), 2).count() == 0


def children(spark, rows):
    return spark.createDataFrame(rows, KINDS)


@pytest.fixture(scope="module")
def one_query(spark):
    return spark.createDataFrame([("q", [0.0])], "query_id string, vector array<float>")


def test_parent_search(spark, one_query):
    kids = children(
        spark,
        [
            ("c1", "a", "p1", "my-repo", [0.1]), ("c2", "b", "p1", "my-repo", [0.2]), ("c3", "c", "gone", "my-repo", [0.3]),
            ("c4", "d", None, "my-repo", [0.4]), ("c5", "e", "p2", "my-repo", [0.5]), ("c6", "e", "p1", "other", [0.6]),
        ],
    )
    parents = spark.createDataFrame(
        [("p1", "my-repo", "Full parent document content"), ("p2", "my-repo", "two"), ("p1", "other", "elsewhere")],
        "id string, repo_id string, content string",
    )
    rows = S.parent_child(kids, parents, one_query, 5).orderBy("rank").collect()
    assert [(r.rank, r.id, r.repo_id, r.content) for r in rows] == [
        (1, "p1", "my-repo", "Full parent document content"), (3, "p2", "my-repo", "two"), (4, "p1", "other", "elsewhere")
    ]
    assert [r.id for r in S.parent_child(kids, parents, one_query, 1).collect()] == ["p1"]


def test_orphans(spark, one_query):
    kids = children(spark, [("c1", "a", None, "r", [0.1]), ("c2", "", "", "r", [0.2]), ("c3", "c", "", "r", [0.3])])
    parents = spark.createDataFrame([], "id string, repo_id string, content string")
    rows = S.parent_child(kids, parents, one_query, 1).orderBy("rank").collect()
    assert [(r.id, r.is_parent) for r in rows] == [("c1", False), ("c3", False)]


def test_chunk_search_drops_empty_after_cut(spark, one_query):
    kids = children(spark, [("c1", "Valid content", None, "r", [0.1]), ("c2", "", None, "r", [0.2]), ("c3", None, None, "r", [0.3]), ("c4", "x", None, "r", [0.4])])
    assert [r.id for r in S.search_chunks(kids, one_query, 3).collect()] == ["c1"]


def test_reserved_filter_is_refused():
    with pytest.raises(ValueError, match="repoId"):
        FL.scope("r", {"repoId": "x"})


def test_filters_are_typed(spark, one_query):
    rows = [("a", [0.1], {"n": "1"}), ("b", [0.2], {"n": '"1"'}), ("c", [0.3], {})]
    corpus = spark.createDataFrame(rows, "id string, vector array<float>, meta map<string,string>")
    assert [r.id for r in S.similarity_search(corpus, one_query, 5, {"n": 1}).collect()] == ["a"]
    assert [r.id for r in S.similarity_search(corpus, one_query, 5, {"n": "1"}).collect()] == ["b"]


def clouds(rows=3000, dim=16, seed=5):
    """Vectors around forty points, a third of all around one of them, some of them equal."""
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(40, dim))
    at = np.where(rng.random(rows) < 1 / 3, 0, rng.integers(0, 40, rows))
    x = (points[at] + rng.normal(scale=0.15, size=(rows, dim))).astype(np.float32)
    x[::50] = x[1]
    return x


def test_inverted_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "SLICE_ROWS", 200)  # several slices in the crowded cells
    x = clouds()
    corpus = spark.createDataFrame([(i, v.tolist(), f"r{i % 3}") for i, v in enumerate(x)], "id int, vector array<float>, repo_id string").repartition(4)
    filed = A.InvertedFile(spark, str(tmp_path / "cells"))
    filed.build(corpus, A.train_centres(corpus, 24, sample_rows=1000))
    assert filed.rows().count() == len(x)
    queries = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = ranked(S.similarity_search(corpus, queries, 10))
    assert ranked(filed.search(queries, 10, 24)) == exact
    found = filed.search(queries, 10, 6, ["repo_id"])
    assert found.columns == ["query_id", "rank", "id", "repo_id", "distance", "score"]
    near = ranked(found)
    assert np.mean([len(set(near[q]) & set(exact[q])) / 10 for q in exact]) >= 0.9
    assert all(r.repo_id == f"r{r.id % 3}" for r in found.collect())


def test_inverted_file_reads_probed_cells_only(spark, tmp_path):
    corpus = spark.createDataFrame([(i, [float(i // 10), 0.0]) for i in range(80)] + [(99, None)], "id int, vector array<float>")
    filed = A.InvertedFile(spark, str(tmp_path / "cells"))
    filed.build(corpus, [[float(c), 0.0] for c in range(9)])  # the last has no vectors
    one = spark.createDataFrame([(1, [3.2, 0.0])], "query_id int, vector array<float>")
    found = filed.search(one, 15, 2)
    assert sorted(r.id for r in found.collect()) == sorted([*range(30, 40), *range(40, 45)])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(3,4\)", plan)
    assert filed.search(one.where("false"), 5, 2).collect() == []


def test_embedder(spark):
    rows = [(1, "Hello world"), (2, "  "), (3, None), (4, "world HELLO"), (5, "other words here")]
    got = {r.i: r.vector for r in E.embed(spark.createDataFrame(rows, "i int, content string")).collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] != got[5]
    assert abs(sum(x * x for x in got[5]) - 1) < 1e-6


def test_pluggable_embedder(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = [(1, "ab\ncd"), (2, " "), (3, "x" * 40000)]
    for most, sent in ((None, 40000.0), (8000, 32000.0)):
        got = {r.i: r.vector for r in E.embed_with(spark.createDataFrame(rows, "i int, content string"), load, max_tokens=most).collect()}
        assert got == {1: [5.0, 1.0], 2: None, 3: [sent, 1.0]}


def test_keyword_hot_word(spark):
    """A word that is in every chunk neither breaks nor dominates the ranking."""
    rows = [(i, f"the the code {'needle' if i == 77 else 'hay'} {i}") for i in range(300)]
    corpus = spark.createDataFrame(rows, "id int, content string").repartition(5)
    queries = spark.createDataFrame([(1, "the needle"), (2, "absent"), (3, "")], "query_id int, text string")
    found = ranked(K.keyword_search(corpus, queries, 3).withColumnRenamed("rank", "score").withColumnRenamed("position", "rank"))
    assert found == {1: [77, 0, 1]}


def test_prompt_search_keeps_to_its_repository(spark):
    chunks = E.embed(spark.createDataFrame(
        [("a:1", "r1", "p1", "alpha beta"), ("a:2", "r2", "p1", "alpha beta"), ("a:3", "r1", "p2", "gamma")],
        "id string, repo_id string, parent_id string, content string",
    ))
    parents = spark.createDataFrame([("p1", "r1", "one"), ("p1", "r2", "two"), ("p2", "r1", "three")], "id string, repo_id string, content string")
    asked = spark.createDataFrame([(1, "r2", "alpha", None), (2, "r1", "gamma", 1.0), (3, "r1", " ", 1.0)], "query_id int, repo_id string, prompt string, k double")
    found = {r.query_id: r.content for r in R.search(asked, chunks, parents).collect()}
    assert found == {1: "two", 2: "three"}
    assert [r.query_id for r in R.prepare(asked)[1].collect()] == [3]


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, id string, rank int")
    assert ranked(S.reciprocal_rank_fusion([a, b], 2)) == {1: ["y", "x"]}
    a, b = a.withColumn("repo_id", F.lit("r")), b.withColumn("repo_id", F.lit("q"))
    hits = S.reciprocal_rank_fusion([a, b], 4).orderBy("rank").select("repo_id", "id").collect()
    assert [tuple(h) for h in hits] == [("r", "x"), ("q", "y"), ("r", "y"), ("q", "z")]


def test_conditions_of_each_query(spark):
    """A row has all entries of the query's map, whatever their number; values of different types differ."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), {"team": f'"t{i % 5}"', "n": str(i % 7), **({"odd": "true"} if i % 2 else {})}) for i in range(400)]
    rows.append((400, [0.0] * 4, None))
    corpus = spark.createDataFrame(rows, "id int, vector array<float>, meta map<string,string>").repartition(5)
    asked = [None, {}, {"team": '"t1"'}, {"n": "3", "odd": "true"}, {"n": '"3"'}, {"absent": "1"}] + [{"n": str(i % 7), "team": f'"t{i % 5}"'} for i in range(35)]
    queries = [(q, rng.normal(size=4).tolist(), m) for q, m in enumerate(asked)]
    got = ranked(S.similarity_search(corpus, spark.createDataFrame(queries, "query_id int, vector array<double>, meta map<string,string>"), 6, meta="meta"))
    for q, v, m in queries:
        held = [(i, np.float32(x).tolist()) for i, x, has in rows if all((has or {}).get(k) == w for k, w in (m or {}).items())]
        assert got.get(q, []) == brute(held, [(q, v)], 6)[q]


def test_equal_ids_of_two_repositories(spark):
    rows = [(7, [1.0, 0.0], repo, "text") for repo in ("b", "a", "c")] + [(3, [1.0, 0.0], "b", "text")]
    corpus = spark.createDataFrame(rows, "id int, vector array<float>, repo_id string, content string").repartition(4)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    found = S.similarity_search(corpus, queries, 3, payload=["repo_id"]).orderBy("rank").collect()
    assert [(r.id, r.repo_id) for r in found] == [(3, "b"), (7, "a"), (7, "b")]


def test_requests_with_metadata(spark):
    from corpuscle.plans import retrieval

    chunks = E.embed(spark.createDataFrame(
        [("r", "1", "alpha beta", "p1", {"team": '"x"'}), ("r", "2", "alpha beta", "p2", {"team": '"y"'}), ("s", "3", "alpha beta", "p3", {"team": '"x"'})],
        "repo_id string, id string, content string, parent_id string, meta map<string,string>",
    ))
    parents = spark.createDataFrame([("r", "p1", "whole 1", {"a": "1"}), ("r", "p2", "whole 2", {"a": "2"})], "repo_id string, id string, content string, meta map<string,string>")
    requests = [
        (1, "r", "alpha", '{"team": "x"}'), (2, "r", "alpha", None), (3, "r", "alpha", '{"team": ["x"]}'), (4, "r", "alpha", '{"chunkType": "x"}'),
        (5, "r", " ", None), (6, "r", "alpha", '{"team": 1}'), (7, "r", None, None),
    ]
    asked = spark.createDataFrame(requests, "query_id int, repo_id string, prompt string, meta string")
    found = retrieval.search_chunks(asked, chunks).collect()
    assert sorted((r.query_id, r.id, r.meta["team"]) for r in found) == [(1, "1", '"x"'), (2, "1", '"x"'), (2, "2", '"y"')]
    whole = retrieval.search(asked, chunks, parents).collect()
    assert sorted((r.query_id, r.id, r.meta["a"]) for r in whole) == [(1, "p1", "1"), (2, "p1", "1"), (2, "p2", "2")]
    refused = {r.query_id: r.error for r in retrieval.prepare(asked)[1].collect()}
    assert refused == {3: "invalid meta", 4: "reserved metadata in filter: chunkType", 5: "no embedding for the prompt", 7: "invalid prompt"}


def test_slices_are_scored_in_tiles(spark):
    """What a slice of the inverted file holds at once does not grow with rows times queries."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    x, t = rng.standard_normal((4000, 8)), rng.standard_normal((1500, 8))
    scale = np.abs(x).max(axis=1) / A.LEVELS
    codes = np.round(x / scale[:, None]).astype(np.int8)
    loss = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    rows = pa.table({"id": np.arange(4000), "code": [c.tobytes() for c in codes], "scale": scale, "loss": loss})
    asked = pa.table({"query_id": np.arange(1500), "target": t.tolist(), A.CELL: np.zeros(1500, np.int32)})
    shared = type("Shared", (), {"value": [[np.zeros(8)]]})()
    tracemalloc.start()
    found = A._bounded(shared, 10)(asked, rows)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    held = set(zip(found["query_id"].to_pylist(), found["id"].to_pylist()))
    near = np.argsort(((t[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert all((q, i) in held for q in range(1500) for i in near[q].tolist())
