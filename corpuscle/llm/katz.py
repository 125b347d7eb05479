"""Scores of texts under a Katz backoff language model over words.

Texts become chunks of token numbers with a dictionary of their own. A chunk asks, in hash buckets,
for the training counts and numbers of its distinct words, for the counts of its distinct pairs of
neighbours, and for what its words are as contexts; a bucket adds up what the chunks bring and answers
each. So counts are summed inside chunks before they move, and neither the dictionary nor the pairs
nor the contexts ever meet in one place. Pairs tell all training words apart; words that training has not
are one class. A caller may ask for a class model instead (``head``), where rarer words join that class,
whose members share its probability by their own counts.

Counts up to ``DISCOUNTED`` are discounted by Good and Turing. What that frees in a context goes to
the words not seen there, in proportion to their own probabilities; the weight makes each context sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import hashing as H
from corpuscle.llm.common import scratch, slots_for, texts_of
from corpuscle.llm.language import fold

DISCOUNTED = 5
CHUNK_TOKENS = 3_000_000
BYTES_AT_ONCE = 4 << 20
END_WORD = 0x0123456789ABCDEF
START = 0
U = np.uint64
CHUNKS = "chunk long, kind int, bucket int, data binary, counts binary, ids array<long>, held array<boolean>, sizes array<int>"
ASKED = "chunk long, kind int, bucket int, data binary, counts binary, own binary"
COUNTED = "chunk long, kind int, bucket int, counts binary, keys binary, own binary, few binary, stats array<long>"
SUMS = "bucket int, context long, seen_p double, total long, freed double"
WORDS, PAIRS, TEXT, TOTALS, CONTEXTS = 1, 2, 0, 3, 4
BINS = 20  # per power of e
SPREAD = 10_000  # occurrences of a context for each bucket that its pairs go to


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed bytes, each as short as the longest needs; first all lowest bytes, last all highest."""
    top = int(x.max(initial=0))
    kind = np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64
    size = np.dtype(kind).itemsize
    return bytes([size]) + zstandard.compress(x.astype(kind).view(np.uint8).reshape(-1, size).T.tobytes(), 1)


def unpack(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x[1:]), np.uint8).reshape(x[0], -1)
    return np.ascontiguousarray(planes.T).view(f"u{x[0]}").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x), dtype=np.uint64)


def discounts(of_count: np.ndarray) -> np.ndarray:
    """Factors for the counts 0 to DISCOUNTED (the first unused); ``of_count[r]`` kinds occur r times."""
    n, k = of_count.astype(float), DISCOUNTED
    out = np.ones(k + 1)
    if n[1] > 0:
        common = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r] > 0 and common < 1:
                out[r] = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
    # Where counts of counts are too few to be smooth, a factor may leave its range.
    return np.where((out > 0) & (out <= 1), out, np.arange(k + 1) / (np.arange(k + 1) + 1.0))


def discounted(count: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return count * np.where(count <= DISCOUNTED, factor[np.minimum(count, DISCOUNTED)], 1.0)


class Model:
    """What tasks need besides the answers: sums over the training text, and the first number of each bucket's words.

    Training words are numbered from 1 in the order of their hashes, by their place among their bucket's.
    """

    def __init__(self, tokens: int, distinct: int, word_counts: np.ndarray, first: np.ndarray, end: int):
        self.tokens, self.distinct, self.word_factor, self.first, self.end = tokens, distinct, discounts(word_counts), first, end
        small = np.arange(DISCOUNTED + 1)
        mass = tokens - float((word_counts[: DISCOUNTED + 1] * small * (1 - self.word_factor)).sum())
        # Some probability must stay for unknown words.
        self.total = float(tokens) if mass < tokens else tokens + 1.0
        self.unknown = 1 - mass / self.total if tokens else 1.0
        self.other = distinct + 1
        if self.other >= 2**32:  # a pair is two numbers in 64 bits
            raise ValueError(f"{distinct} distinct training words")
        self.least, self.other_p = 1, self.unknown
        self.pair_factor = None
        self.special = {}  # weights and totals of the start and the class of other words as contexts

    def word_p(self, count: np.ndarray) -> np.ndarray:
        return discounted(count, self.word_factor) / max(self.total, 1)

    def word_id(self, bucket: int, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Numbers of a bucket's words, from their places and counts."""
        number = self.first[bucket] + place.astype(np.int64)
        return np.where((count > 0) & ((count >= self.least) | (number == self.end)), number, self.other)

    def share(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A word's part of its class: 1 for a word with a number."""
        own = np.where(count > 0, self.word_p(count), self.unknown)
        return np.where(ids == self.other, own / self.other_p, 1.0)

    def context(self, seen_p: np.ndarray, total: np.ndarray, freed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of words not seen in contexts, and factor of those seen; ``seen_p`` is the own probability of those seen."""
        kept = np.where(freed > 0, 1.0, total / (total + 1.0))
        left = 1 - kept * (total - freed) / total
        rest = 1 - seen_p
        weight = np.where(rest > 1e-9, left / np.maximum(rest, 1e-9), 0.0)
        return weight, np.where(rest > 1e-9, kept, kept / (1 - left))


def _chunked(buckets: int, chunk_tokens: int):
    """Chunks: tokens as numbers of a sorted dictionary, and the training counts of its words by bucket."""

    def emit(number, codes, ids, held, sizes):
        code = np.concatenate(codes)
        vocab, token = np.unique(code, return_inverse=True)
        train = np.repeat(~np.array(held, bool), sizes)
        count = np.bincount(token[train], minlength=len(vocab))
        edge = np.searchsorted(vocab, np.arange(1, buckets, dtype=np.uint64) * U(2**64 // buckets))
        chunk = (TaskContext.get().partitionId() << 32) + number
        rows = [{"chunk": chunk, "kind": TEXT, "bucket": -1, "data": pack(token), "ids": ids, "held": held, "sizes": sizes}]
        for b, (w, n) in enumerate(zip(np.split(vocab, edge), np.split(count, edge), strict=True)):
            if len(w):
                rows.append({"chunk": chunk, "kind": WORDS, "bucket": b, "data": pack_sorted(w), "counts": pack(n)})
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()), ("counts", pa.binary())]
            + [("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32()))]
        )
        number, codes, ids, held, sizes, size = 0, [], [], [], [], 0
        for batch in batches:
            for part in H.parts(batch, BYTES_AT_ONCE):
                code, edge = H.words(part.column("text"), lower=True)
                codes.append(np.insert(code, edge[1:], U(END_WORD)))
                ids += part.column("doc_id").to_pylist()
                held += part.column("held_out").to_pylist()
                sizes += (np.diff(edge) + 1).tolist()
                size += len(codes[-1])
                if size >= chunk_tokens:
                    yield pa.RecordBatch.from_pylist(emit(number, codes, ids, held, sizes), schema)
                    number, codes, ids, held, sizes, size = number + 1, [], [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist(emit(number, codes, ids, held, sizes), schema)

    return run


def _answers(table: pa.Table, kind: int):
    """Totals of a bucket's keys, and each chunk's answer, in the order of its question."""
    asked = [unpack_sorted(x.as_py()) for x in table.column("data")]
    count = np.concatenate([unpack(x.as_py()).astype(np.int64) for x in table.column("counts")])
    key, at = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(at, weights=count, minlength=len(key)).astype(np.int64)
    bucket = table.column("bucket")[0].as_py()
    edge = np.cumsum([len(a) for a in asked])[:-1]
    rows = [
        {"chunk": c, "kind": kind, "bucket": bucket, "counts": pack(total[part])}
        for c, part in zip(table.column("chunk").to_pylist(), np.split(at, edge), strict=True)
    ]
    return bucket, key, total, rows, at


SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary()), ("keys", pa.binary()), ("own", pa.binary()), ("few", pa.binary()), ("stats", pa.list_(pa.int64()))]
)


def _few(total: np.ndarray) -> np.ndarray:
    return np.bincount(total[total <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)


def _level(total: np.ndarray) -> np.ndarray:
    return np.floor(np.log(total) * BINS).astype(np.int64)


def _count_words(table: pa.Table) -> pa.Table:
    bucket, key, total, rows, at = _answers(table, WORDS)
    place = np.cumsum(total > 0).astype(np.uint64)
    for row, part in zip(rows, np.split(at, np.cumsum([len(unpack(r["counts"])) for r in rows])[:-1]), strict=True):
        row["keys"] = pack_sorted(place[part])
    held = total > 0
    end = int(place[held & (key == U(END_WORD))].sum())
    total = total[held]
    stats = [int(total.sum()), len(total), *_few(total).tolist(), end, *np.bincount(_level(total), minlength=44 * BINS).tolist()]
    rows.append({"chunk": -1, "kind": TOTALS, "bucket": bucket, "counts": pack(total), "stats": stats})
    return pa.Table.from_pylist(rows, SCHEMA)


def _known_p(model: Model):
    """Probability of the words with a number, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, counts in zip(batch.column("bucket").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = unpack(counts).astype(np.int64)
                known = model.word_id(bucket, np.arange(1, len(n) + 1), n) != model.other
                yield pa.RecordBatch.from_arrays([pa.array([float(model.word_p(n[known]).sum())])], names=["p"])

    return run


def _tokens(row, model: Model, answers):
    """Of a chunk: numbers and counts of its words, word and number of each token, and the pair it makes with the one before."""
    token = unpack(row["data"]).astype(np.int64)
    counts = [unpack(a["counts"]).astype(np.int64) for a in answers]
    known = np.concatenate([model.word_id(a["bucket"], unpack_sorted(a["keys"]), n) for a, n in zip(answers, counts, strict=True)])
    ids = known[token]
    context = np.concatenate([[START], ids[:-1]])
    edge = np.cumsum([0, *row["sizes"]])
    context[edge[:-1]] = START
    pair, at = np.unique((context.astype(np.uint64) << U(32)) | ids.astype(np.uint64), return_inverse=True)
    return known, np.concatenate(counts), token, ids, edge, pair, at


def _entries(model: Model, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a chunk have numbers, and these numbers between those of the start and the other words."""
    own = np.flatnonzero(known != model.other)
    return own, np.concatenate([[START], known[own], [model.other]])


def _split(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pair >> U(32)).astype(np.int64), (pair & U(2**32 - 1)).astype(np.int64)


def _pairs_of(pair: np.ndarray, number: np.ndarray, count: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs by bucket and then in order, and the bucket of each; ``count`` has the words of ``number``.

    The pairs of a context share a bucket, those of a frequent one as many as its count asks for. So a bucket
    has nearly all of a context to add up, and none has all of the most frequent ones.
    """
    context = pair >> U(32)
    often = np.concatenate([[1 << 40], count, [1 << 40]])[np.searchsorted(number, context.astype(np.int64))]
    part = H.mix(pair + U(7)) % (often // SPREAD + 1).astype(np.uint64)
    bucket = (H.blend(context, part) % U(buckets)).astype(np.int64)
    by = np.lexsort((pair, bucket))
    return by, bucket[by]


def _ask_pairs(model: Model, buckets: int):
    """A chunk's pairs, their training counts, and the training counts of the second words of those in training."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        text = next(r for r in rows if r["kind"] == TEXT)
        answers = sorted((r for r in rows if r["kind"] == WORDS), key=lambda r: r["bucket"])
        known, word_count, _, _, _, pair, at = _tokens(text, model, answers)
        train = np.repeat(~np.array(text["held"], bool), text["sizes"])
        count = np.bincount(at[train], minlength=len(pair))
        own, number = _entries(model, known)
        follower = np.concatenate([[0], word_count[own], [0]])[np.searchsorted(number, _split(pair)[1])]
        follower[count == 0] = 0
        by, bucket = _pairs_of(pair, number, word_count[own], buckets)
        out = []
        edge = np.flatnonzero(np.diff(bucket)) + 1
        for part, b in zip(np.split(by, edge), bucket[np.concatenate([[0], edge])].tolist(), strict=True):
            packed = {"data": pack_sorted(pair[part]), "counts": pack(count[part]), "own": pack(follower[part])}
            out.append({"chunk": text["chunk"], "kind": PAIRS, "bucket": b, **packed})
        binary = [(n, pa.binary()) for n in ("data", "counts", "own")]
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), *binary]))

    return run


def _count_pairs(model: Model):
    """Answers with counts, and sums over the pairs by context: occurrences, followers of few occurrences, their own probability."""

    def run(table: pa.Table) -> pa.Table:
        bucket, key, total, rows, at = _answers(table, PAIRS)
        brought = np.concatenate([unpack(x.as_py()).astype(np.int64) for x in table.column("own")])
        own = np.zeros(len(key), np.int64)
        own[at[brought > 0]] = brought[brought > 0]  # all chunks bring the same
        held = total > 0
        n, own = total[held], own[held]
        before, word = _split(key[held])
        context, at = np.unique(before, return_inverse=True)
        add = lambda w: np.bincount(at, weights=w, minlength=len(context))
        few = np.concatenate([add(n == r).astype(np.int64) for r in range(1, DISCOUNTED + 1)])
        seen_p = add(np.where(word == model.other, model.other_p, model.word_p(own)))
        packed = {
            "keys": pack_sorted(context.astype(np.uint64)), "counts": pack(add(n).astype(np.int64)),
            "own": pack(seen_p.view(np.uint64)), "few": pack(few),
        }
        rows.append({"chunk": -1, "kind": TOTALS, "bucket": bucket, "stats": _few(n).tolist(), **packed})
        return pa.Table.from_pylist(rows, SCHEMA)

    return run


def _contexts(model: Model):
    """The sums of the contexts, for the bucket of the context's word; -1 is for contexts that are no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost = np.arange(1, DISCOUNTED + 1) * (1 - model.pair_factor[1:])
        for batch in batches:
            for keys, counts, own, few in zip(*[batch.column(n).to_pylist() for n in ("keys", "counts", "own", "few")], strict=True):
                context = unpack_sorted(keys).astype(np.int64)
                bucket = np.searchsorted(model.first, context, "left") - 1
                bucket[(context == START) | (context == model.other)] = -1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket.astype(np.int32)), pa.array(context), pa.array(unpack(own).astype(np.uint64).view(float)),
                        pa.array(unpack(counts).astype(np.int64)), pa.array(lost @ unpack(few).reshape(DISCOUNTED, -1)),
                    ],
                    names=["bucket", "context", "seen_p", "total", "freed"],
                )

    return run


def _answer_contexts(model: Model):
    """What the words that chunks ask a bucket for are as contexts: occurrences, weight and factor."""

    def run(sums: pa.Table, asked: pa.Table) -> pa.Table:
        context, at = np.unique(sums.column("context").to_numpy(), return_inverse=True)
        add = lambda n: np.bincount(at, weights=sums.column(n).to_numpy(), minlength=len(context))
        total = add("total")
        weight, kept = model.context(add("seen_p"), total, add("freed"))
        # Last, what a word never before another one in training has.
        total, weight, kept = np.append(total, 0).astype(np.int64), np.append(weight, 1.0), np.append(kept, 1.0)
        out = []
        for row in asked.to_pylist():
            ids = model.word_id(row["bucket"], unpack_sorted(row["keys"]), unpack(row["counts"]).astype(np.int64))
            place = np.searchsorted(context, ids)
            hit = place < len(context)
            hit[hit] = context[place[hit]] == ids[hit]
            place[~hit] = len(context)
            packed = {"counts": pack(total[place]), "keys": pack(weight[place].view(np.uint64)), "own": pack(kept[place].view(np.uint64))}
            out.append({"chunk": row["chunk"], "kind": CONTEXTS, "bucket": row["bucket"], **packed})
        return pa.Table.from_pylist(out, SCHEMA)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        text = next(r for r in rows if r["kind"] == TEXT)
        known, word_counts, token, ids, edge, pair, at = _tokens(text, model, [r for r in rows if r["kind"] == WORDS])
        word_count = word_counts[token]
        own, number = _entries(model, known)
        by, _ = _pairs_of(pair, number, word_counts[own], buckets)
        count = np.empty(len(pair), np.int64)
        count[by] = np.concatenate([unpack(r["counts"]).astype(np.int64) for r in rows if r["kind"] == PAIRS])

        def entries(read, k):
            """Of contexts: the start's, those of the words with numbers, and that of the other words."""
            inner = np.concatenate([read(r) for r in rows if r["kind"] == CONTEXTS])[own]
            return np.concatenate([[model.special[START][k]], inner, [model.special[model.other][k]]])

        total = entries(lambda r: unpack(r["counts"]).astype(float), 0)
        weight = entries(lambda r: unpack(r["keys"]).astype(np.uint64).view(float), 1)
        kept = entries(lambda r: unpack(r["own"]).astype(np.uint64).view(float), 2)
        p = np.concatenate([[0.0], model.word_p(word_counts[own]), [model.other_p]])
        context, word = (np.searchsorted(number, x) for x in _split(pair))
        # By the pair's count, else backed off to the word alone
        seen = discounted(count, model.pair_factor) * kept[context] / np.maximum(total[context], 1)
        log = np.log10(np.where(count > 0, seen, weight[context] * p[word]))[at] + np.log10(model.share(ids, word_count))
        base = np.log10((word_count + 1) / (model.tokens + model.distinct + 1))
        add = lambda x: np.add.reduceat(x, edge[:-1])
        return pa.table(
            {
                "doc_id": pa.array(text["ids"], pa.int64()),
                "held_out": pa.array(text["held"], pa.bool_()),
                "n_tokens": pa.array(np.diff(edge)),
                "n_known": pa.array(add((word_count > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(edge) - 1, model.tokens, np.int64)),
                "base_score": pa.array(add(base)),
                "score": pa.array(add(log)),
            }
        )

    return run


def learn_words(totals: DataFrame, head: int | None, buckets: int) -> Model:
    """From the word totals of all buckets. One row of sums and two numbers a bucket come to the driver."""
    sums = [F.sum(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(2 + DISCOUNTED + 2)]
    got = [x or 0 for x in totals.agg(*sums).first()]
    size, place = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in totals.select("bucket", F.get("stats", F.lit(1)).alias("n"), F.get("stats", F.lit(2 + DISCOUNTED + 2)).alias("end")).collect():
        size[r.bucket], place[r.bucket] = r.n, r.end
    first = np.cumsum(size) - size
    end = int((first + place)[place > 0].sum())
    model = Model(got[0], got[1], np.array(got[2:]), first, end)
    if head is None:
        return model
    by_level = totals.select(F.posexplode(F.slice("stats", 4 + DISCOUNTED + 2, 44 * BINS)).alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n"))
    at, level = 0, 44 * BINS
    for r in by_level.where("n > 0").orderBy(F.desc("level")).collect():  # at most 880 rows
        if at + r.n > head:
            break
        at, level = at + r.n, r.level
    # The least count whose level is among the chosen
    least = int(np.ceil(np.exp(level / BINS) - 1e-9)) if level else 1
    while least > 1 and int(_level(np.array([least - 1]))[0]) >= level:
        least -= 1
    model.least = least
    known = totals.select("bucket", "counts").mapInArrow(_known_p(model), "p double").agg(F.sum("p")).first()[0]
    model.other_p = max(1 - (known or 0.0), model.unknown)
    return model


def scored(docs: DataFrame, head: int | None = None, folds: int = 7, held: int = 2, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per document.

    Learns from the documents whose crc32 of the id as text, modulo ``folds``, is not ``held`` (a null id
    counts as empty text). A-Z is lower-cased; tokens are words and one end. A null text is only an end. ``score`` is
    the log10 probability under the Katz model, ``base_score`` that under add-one counts. Repeated rows count as often as
    they occur. With nothing to learn from, the unknown word has probability 1. With ``head``, pairs tell only about
    that many of the most frequent words apart; without it, all.
    """
    spark = docs.sparkSession
    buckets = slots_for(spark)
    texts = texts_of(docs).withColumn("held_out", fold(docs, folds) == held).select("doc_id", "text", "held_out")
    chunks = scratch(texts.mapInArrow(_chunked(buckets, chunk_tokens), CHUNKS), "chunks")
    words = scratch(chunks.where(F.col("kind") == WORDS).select("chunk", "bucket", "data", "counts").groupBy("bucket").applyInArrow(_count_words, COUNTED), "words")
    model = learn_words(words.where(F.col("kind") == TOTALS), head, buckets)
    answered = words.where(F.col("kind") == WORDS).drop("stats")
    both = chunks.where(F.col("kind") == TEXT).unionByName(answered, allowMissingColumns=True)

    asked = scratch(both.groupBy("chunk").applyInArrow(_ask_pairs(model, buckets), ASKED), "asked")
    pairs = scratch(asked.groupBy("bucket").applyInArrow(_count_pairs(model), COUNTED), "pairs")
    pair_totals = pairs.where(F.col("kind") == TOTALS)
    few = [x or 0 for x in pair_totals.agg(*[F.sum(F.get("stats", F.lit(k))) for k in range(DISCOUNTED + 2)]).first()]
    model.pair_factor = discounts(np.array(few))
    sums = pair_totals.select("keys", "counts", "own", "few").mapInArrow(_contexts(model), SUMS)
    model.special = {START: (0.0, 1.0, 1.0), model.other: (0.0, 1.0, 1.0)}
    special = sums.where("bucket = -1").groupBy("context").agg(*[F.sum(n).alias(n) for n in ("seen_p", "total", "freed")])
    for r in special.collect():  # two rows at most
        weight, kept = model.context(np.array([r.seen_p]), np.array([float(r.total)]), np.array([r.freed]))
        model.special[r.context] = (float(r.total), float(weight[0]), float(kept[0]))
    contexts = sums.where("bucket >= 0").groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(_answer_contexts(model), COUNTED)

    counts = pairs.where(F.col("kind") == PAIRS).select("chunk", "kind", "bucket", "counts")
    both = both.unionByName(counts, allowMissingColumns=True).unionByName(contexts.drop("stats"), allowMissingColumns=True)
    return both.groupBy("chunk").applyInArrow(_score(model, buckets), SCORES)
