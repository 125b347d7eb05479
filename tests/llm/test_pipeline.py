import hashlib
import struct
import zlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpuscle.llm import language, mixing
from tests.llm.test_minhash import shingles


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        per = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * per > most * sizes[s]}
        if not full:
            return target | {s: weight[s] * per for s in free}
        target |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return target


def test_targets_equal_resharing(spark):
    for sizes in ({"a": 10, "b": 500, None: 70, "c": 0, "d": 33}, {"x": 1, "y": 1000}, {"z": 0}, {str(k): k * k for k in range(30)}):
        rows = spark.createDataFrame([(str(s), s, n) for s, n in sizes.items()], "src string, source string, source_size long")
        mine = {r.src: r.target for r in mixing.targets(rows).collect()}
        for s, t in brute_targets(sizes).items():
            assert abs(mine[str(s)] - t) < 1e-6


def test_mix_meets_budgets_with_nulls_and_repeated_rows(documents):
    rows = [(i % 20, " ".join("w" * (i % 7)), "en", ["a", "b", None][i % 3]) for i in range(90)] + [(None, None, None, "b"), (1, "", "en", "z")]
    got = mixing.mixed(documents(rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    by = Counter()
    for r in got:
        by[r.source_size, r.target] += r.taken
    assert all(words == int(target) for (_, target), words in by.items() if target)
    assert mixing.mixed(documents(rows).where("false")).count() == 0
    whole = mixing.materialised(documents(rows)).collect()
    assert abs(sum(len(r.text.split()) for r in whole) - sum(r.taken for r in got)) <= len(rows)


def test_equal_rows_of_two_sources_are_taken_apart(documents):
    rows = [(1, "a b c d e f", "en", "s1"), (1, "a b c d e f", "en", "s2"), (2, "x y z", "en", "s2"), (3, "k " * 40, "en", "s3")]
    want = Counter()
    for r in mixing.mixed(documents(rows)).collect():
        want[r.src[1:]] += r.taken
    got = Counter()
    for r in mixing.materialised(documents(rows)).collect():
        got[r.source] += len(r.text.split())
    assert got == +want


def test_stages_keep_columns_whose_names_clash(documents):
    """Predictions and inner names don't replace columns; names may hold dots or differ in case only."""
    base = documents([(1, "the cat sat on the mat today"), (2, None), (3, "1 2 3"), (4, "a dog ran over the wide field")])
    names = ["score", "lang_pred", "_row_of_text", "_copy", "a.b", "Text", "shingle"]
    docs = base.select(*base.columns, *[F.lit(9.5).alias(n) for n in names])
    for stage in (corpus_pipeline.language_id, corpus_pipeline.near_dedup, corpus_pipeline.decontamination, corpus_pipeline.source_mixing):
        out = stage(docs.sparkSession, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(tuple(r)[-len(names) :] == (9.5,) * len(names) for r in rows)
        assert {r.doc_id for r in rows} >= {1, 4}


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if any(c.isalpha() for c in r.text or "")]
    sets = [shingles(r.text) for r in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if 100 * x >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda k: docs[k].doc_id)
                root[b] = a
    left = [r for i, r in enumerate(docs) if find(i) == i]
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [r for r in left if not any(len(shingles(r.text) & s) >= 0.75 * len(s) for s in items)]
    sizes = Counter()
    for r in left:
        sizes[r.source] += len(r.text.split())
    target, taken = brute_targets(sizes), []
    for source in sizes:
        key = lambda r: hashlib.md5(f"mix{r.doc_id}".encode()).hexdigest()
        budget = int(target[source])
        mine = sorted((r for r in left if r.source == source), key=key)
        while budget > 0:
            for r in mine:
                ws = r.text.split()
                if budget > 0:
                    taken.append((r.doc_id, r.text if len(ws) <= budget else " ".join(ws[:budget])))
                budget -= len(ws)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expect = []
    for d, t in taken:
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        expect.append((d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(expect)


def test_language_stage_keeps_clean_documents(spark, documents):
    docs = documents([(1, "the cat"), (2, "--- 1"), (3, None), (4, "le chat", None)])
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 4]
    assert language.fold(docs, 3) is not None
