"""Search on stored postings against the scan of all chunks."""

import random

import pytest

from corpuscle.operators import postings
from corpuscle.operators.keyword import keyword_search


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    rows = [(f"r{i % 3}", f"c{i // 3}", " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(1, 40)))) for i in range(3000)]
    rows += [("r0", "none", None), (None, "free", "w1 lonely"), ("r1", "blank", "  "), ("r2", "hot", "w0 " * 500)]
    return spark.createDataFrame(rows, "repo_id string, id string, content string").repartition(5)


QUERIES = [(1, "w0 w1 w2"), (2, "w50 w59"), (3, "absent"), (4, ""), (5, None), (6, "w3 w3 lonely"), (7, "w0")]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    made = postings.Index(spark, str(tmp_path_factory.mktemp("postings")), 8)
    made.build(corpus)
    return made


def rows(df):
    return sorted((r.query_id, r.position, r.rank) for r in df.collect())


@pytest.mark.parametrize("seeds", [1, 4])
def test_equals_the_scan(spark, corpus, index, seeds):
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    got = index.search(queries, 7, seeds=seeds)
    whole = keyword_search(corpus, queries, 7, payload=["repo_id"])
    assert rows(got) == rows(whole)
    ranks = {}
    for r in got.collect():
        ranks.setdefault((r.query_id, r.rank), []).append((r.id, r.repo_id or ""))
    assert all(found == sorted(found) for found in ranks.values())


def test_queries_of_one_repository(spark, corpus, index):
    """Each has the best of its repository, by the statistics of all."""
    queries = [(1, "w0 w9", "r1"), (2, "w0 w9", None), (3, "w9 w9", "absent"), (4, "lonely", "r0")]
    got = index.search(spark.createDataFrame(queries, "query_id int, text string, repo_id string"), 5).collect()
    every = keyword_search(corpus, spark.createDataFrame([(1, "w0 w9"), (2, "w0 w9")], "query_id int, text string"), 4000, payload=["repo_id"]).collect()
    for q, repo in ((1, "r1"), (2, None)):
        best = sorted(((-r.rank, r.id, r.repo_id or "") for r in every if r.query_id == q and (repo is None or r.repo_id == repo)))[:5]
        assert [(-r.rank, r.id, r.repo_id or "") for r in sorted(got, key=lambda r: r.position) if r.query_id == q] == best
    assert {r.query_id for r in got} == {1, 2}


def test_only_the_words_buckets_are_read(spark, index):
    terms = spark.createDataFrame([("lonely",)], "term string")
    plan = index.postings(terms)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:80]
    assert len(index.postings(terms).select("bucket").distinct().collect()) == 1


def test_unpromising_ranges_are_not_scored(spark, corpus, index):
    """A rare word's range is far above what common words can add elsewhere."""
    scored = []
    whole = index._scored
    index._scored = lambda pairs, *rest: scored.append(pairs.count()) or whole(pairs, *rest)
    index.search(spark.createDataFrame([(1, "lonely w0")], "query_id int, text string"), 1, seeds=1).collect()
    del index._scored
    assert sum(scored) < index.ranges().select("range").distinct().count()


def test_empty_index(spark, corpus, tmp_path):
    made = postings.Index(spark, str(tmp_path), 2)
    made.build(corpus.where("false"))
    assert made.search(spark.createDataFrame(QUERIES, "query_id int, text string")).collect() == []


def test_counts_leave_a_batch_by_word_and_range():
    """Not a row for each word of each chunk: what a word has in a range is one row before the shuffle."""
    import pyarrow as pa

    from corpuscle.operators import postings as P

    docs = [5, 6, 1023, 1024, (1 << 33) + 1]
    words = [["a", "b", "a"], ["b"], ["a"], ["a", "a"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(docs), pa.array(words)], names=["doc", "words"])
    empty = batch.slice(0, 0)
    made = [r for part in P._count([batch, empty, batch.slice(4)]) for r in part.to_pylist()]
    assert sorted(tuple(r.values()) for r in made) == [
        ("a", 0, [5, 1023], [2, 1], [3, 1]), ("a", 1, [1024], [2], [2]), ("b", 0, [5, 6], [1, 1], [3, 1]),
    ]
