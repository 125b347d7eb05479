from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from corpuscle.llm import katz, language, token_files
from corpuscle.llm.registry import query, table

TOKENIZER = "byte_bpe_50k.json"


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = language.fold(docs, 3)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (part == 1).alias("held_out"))
    return language.identified(texts, docs.where(part != 1)).select("doc_id", "held_out", "lang_pred", "score")


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return token_files.read_tokens(manifest)


@query("op2_lm_scoring")
def op2_lm_scoring(spark, sf_dir):
    return katz.scored(table(spark, sf_dir, "documents"))
