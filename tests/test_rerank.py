import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import rerank as R
from corpuscle.operators import search as S


def points(n, seed, size=4):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in np.round(rng.normal(size=size), 2)] for _ in range(n)]


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def corpus(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "id long, vector array<float>").repartition(3)


def brute_mmr(found, k, balance):
    left, picked = list(found), []
    while left and len(picked) < k:
        worth = [
            balance * (1 - d) - (1 - balance) * max(1 - distance(v, p[1]) for p in picked) if picked else 1 - d for _, v, d in left
        ]
        picked.append(left.pop(max(range(len(left)), key=lambda i: (round(worth[i], 9), -i))))
    return [p[0] for p in picked]


@pytest.mark.parametrize("balance", [0.0, 0.5, 1.0])
def test_diversified_equals_brute_force(spark, balance):
    vectors = points(40, 1) + points(3, 1)  # the last three are copies
    asked = points(6, 2)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, vector array<float>")
    hits = S.similarity_search(corpus(spark, vectors), queries, 12, payload=["vector"])
    got = {}
    for r in R.diversified(hits, 5, balance).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    single = [[float(np.float32(x)) for x in v] for v in vectors]
    for q, a in enumerate(asked):
        a = [float(np.float32(x)) for x in a]
        near = sorted((distance(a, v), i) for i, v in enumerate(single))[:12]
        assert got[q] == brute_mmr([(i, single[i], d) for d, i in near], 5, balance)


def test_diversified_leaves_hits_without_vector_and_takes_what_there_is(spark):
    rows = [(1, 1, "a", 0.5, [1.0, 0.0]), (1, 2, "b", 0.4, None), (2, 1, "c", 0.1, [0.0, 0.0])]
    hits = spark.createDataFrame(rows, "query_id long, rank int, id string, score double, vector array<double>")
    out = R.diversified(hits, 5)
    assert sorted((r.query_id, r.id, r.found_rank, r.rank) for r in out.collect()) == [(1, "a", 1, 1), (2, "c", 1, 1)]
    assert R.diversified(hits.where("false")).count() == 0


def test_compressed_keeps_the_best_sentences_in_order(spark):
    text = "Cats sleep. Dogs bark at cats! Nothing here. Do dogs bark?  A cat, a dog"
    hits = spark.createDataFrame([(1, "x", text), (1, "y", "unlike"), (1, "z", ""), (1, "n", None), (2, "x", text)], "query_id long, id string, content string")
    queries = spark.createDataFrame([(1, "dogs BARK cats cats"), (2, None), (3, "dogs")], "query_id long, text string")
    got = {(r.query_id, r.id): r.content for r in R.compressed(hits, queries, 2).collect()}
    assert got == {(1, "x"): "Dogs bark at cats! Do dogs bark?"}
    one = {r.id: r.content for r in R.compressed(hits, queries.where("query_id = 1").withColumn("text", F.lit("cats")), 1).collect()}
    assert one == {"x": "Cats sleep."}


def test_second_hop_equals_brute_force(spark):
    vectors, asked = points(50, 3), points(5, 4)
    queries = spark.createDataFrame([(100 + i, v) for i, v in enumerate(asked)], "query_id long, vector array<float>")
    got = {}
    for r in R.second_hop(corpus(spark, vectors), queries, 6, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.hops, r.via, r.distance))
    single = [[float(np.float32(x)) for x in v] for v in vectors]

    def nearest(a):
        return sorted((distance(a, v), i) for i, v in enumerate(single))[:6]

    for q, a in enumerate(asked):
        a = [float(np.float32(x)) for x in a]
        first = nearest(a)
        ways = {i: (round(d, 9), 1, -1) for d, i in first}
        for d, seed in first[:2]:
            for e, i in nearest(single[seed]):
                ways[i] = min(ways.get(i, (9e9, 0, 0)), (round(d + e, 9), 2, seed))
        best = sorted((w, i) for i, w in ways.items())
        best.sort(key=lambda x: (x[0][0], x[1]))
        want = [(i, w[1], None if w[2] < 0 else w[2], w[0]) for w, i in best[:6]]
        assert [g[:3] for g in got[100 + q]] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got[100 + q]], [w[3] for w in want], atol=1e-8)
