"""From raw documents to token files, in stages that each read what the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import containment, language, minhash, mixing, token_files
from corpuscle.llm.common import plain_names, scratch

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter.

    All other rows stay as they are, repeated rows and null ids too. Without labelled rows nothing is known, and all go.
    """

    def known(d: DataFrame) -> DataFrame:
        return language.identified(d, d.where(language.fold(d, 3) != 1)).where(F.col("lang_pred") != language.UNKNOWN)

    return plain_names(docs, known)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates. Texts without words are linked with nothing and stay."""
    return plain_names(docs, minhash.deduplicated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none; items without words are in none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return plain_names(docs, lambda d: containment.decontaminated(d, items))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents so that sources get their target weights.

    Null sources are one source; documents without words are not taken. Repeated rows share what they are taken.
    """
    return plain_names(docs, mixing.materialised)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files, and returns what is read back from them."""
    return token_files.read_tokens(token_files.write_tokens(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

# Language profiles and the tokenizer are beyond SQL: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
