"""How files are cut into units and looked at."""

import random
import re

from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators.chunking import blocks, lexing


def test_rules_are_tried_at_the_start_only(spark):
    rows = blocks.dimension(spark).select("_any", "_rules.pattern").collect()
    assert all(r["_any"].startswith(r"\A(?:") for r in rows)
    assert all(re.match(r"(\(\?[is]+\))?\^", p) for r in rows for p in r["pattern"])


def test_whole_units_are_those_of_the_split(spark):
    rng = random.Random(3)
    texts = ["", "\n", ";", "a", "a\n", "\n\na", "{}[],\n;é\n"] + ["".join(rng.choice("a é\n\n;{}[],") for _ in range(rng.randrange(25))) for _ in range(400)]
    df = spark.createDataFrame([(t, p) for t in texts for p in lexing.PLAIN_SPLITS], "t string, p string")
    cut = df.select(lexing.units(F.col("t"), F.lit("."), F.col("t"), F.col("p")).alias("mine"), F.split("t", F.col("p")).alias("split"))
    assert cut.where("mine <> split").count() == 0
    assert set(lexing.PLAIN_SPLITS) < {*lexing.SPLITS.values(), r"(?<=[{};])", r"(?<=[{};\n])"}


def test_line_feeds_are_not_translated():
    """A translation makes a string of every character."""
    assert all("translate" not in str(c) for c in (lexing.newlines(F.lit("a")), text.embed_prep(F.lit("a"))))


def test_line_feeds_and_idle_units(spark):
    rows = [("", 0, True), ("a\n\x04é\n", 3, False), (" \t\x01\x04\n", 2, True), ("é", 0, False), ("\x02", 0, False), (" a", 0, False)]
    df = spark.createDataFrame(rows, "u string, n int, idle boolean")
    assert df.where((lexing.newlines(F.col("u")) != F.col("n")) | (lexing.idle(F.col("u")) != F.col("idle"))).count() == 0
