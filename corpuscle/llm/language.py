"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams of a language, or of a document, by rank. A
document's language is the one whose profile is nearest by out-of-place distance: how far each of the
document's n-grams stands from its place in the language's profile, all of the profile if it is missing there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm import hashing as H

RANKS = 300
BYTES_AT_ONCE = 1 << 19
UNKNOWN = "und"
U = np.uint64
_letter: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def ngrams(text: str) -> np.ndarray:
    """Codes of the 1- to 3-grams of all words of lower-case letters; 2- and 3-grams see word ends."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[code]
    code = np.where(letter, code, 0).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one end per word
    word = np.concatenate([[U(0)], code[keep], [U(0)]])
    two = (word[:-1] << U(21)) | word[1:]
    three = (two[:-1] << U(21)) | word[2:]
    one = word[word > 0]
    pairs = two[(word[:-1] > 0) | (word[1:] > 0)]
    return np.concatenate([one | U(1 << 63), pairs | U(1 << 62) | U(1 << 63), three[word[1:-1] > 0]])


def profile(grams: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent n-grams in order, of equals the smaller code first."""
    code, count = np.unique(grams, return_counts=True)
    if len(code) > ranks:
        least = np.partition(count, len(count) - ranks)[len(count) - ranks]
        some = count >= least
        code, count = code[some], count[some]
    return code[np.argsort(-count, kind="stable")][:ranks]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in H.parts(batch, BYTES_AT_ONCE):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                code, count = np.unique(ngrams("\n".join(texts)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), H.signed(code), pa.array(count)], names=["lang", "gram", "n"])


def learned(labelled: DataFrame, ranks: int = RANKS) -> DataFrame:
    """``lang, gram, place``: the profile of each language, from ``text, lang`` without nulls."""
    counts = labelled.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Codes are unsigned inside tasks
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    return counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < ranks).select("lang", "gram", "place")


class Judge:
    """Out-of-place distances to several profiles at once."""

    def __init__(self, rows, ranks: int):
        self.ranks, self.langs = ranks, sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64).view(np.uint64))
        self.place = np.full((len(self.grams) + 1, max(1, len(self.langs))), -1, np.int64)
        column = {lang: k for k, lang in enumerate(self.langs)}
        for lang, gram, place in rows:
            self.place[np.searchsorted(self.grams, np.array([gram]).view(np.uint64))[0], column[lang]] = place

    def __call__(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text or "")
        if len(grams) == 0 or not self.langs:
            return UNKNOWN, 0.0
        own = profile(grams, self.ranks)
        at = np.searchsorted(self.grams, own)
        at[at < len(self.grams)] = np.where(self.grams[at[at < len(self.grams)]] == own[at < len(self.grams)], at[at < len(self.grams)], len(self.grams))
        place = self.place[at]
        off = np.where(place < 0, self.ranks, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(off.argmin())
        return self.langs[best], 1 - float(off[best]) / (self.ranks * len(own))


def identified(docs: DataFrame, labelled: DataFrame, ranks: int = RANKS) -> DataFrame:
    """Adds ``lang_pred, score`` to rows that have ``text``; profiles are learned from all rows ``text, lang`` of ``labelled``.

    ``score`` is 1 at the distance 0 and 0 where no n-gram is known. A text that is null or has no letter is
    ``und`` with score 0, as is any text if nothing was learned. Equally near languages: first by name.
    The profiles, ``ranks`` rows per language, go to every task.
    """
    known = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = [tuple(r) for r in learned(known, ranks).collect()]
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "text")]
    schema = docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep]).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rows, ranks)
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column("text")]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def fold(docs: DataFrame, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
