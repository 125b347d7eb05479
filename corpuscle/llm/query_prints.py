from __future__ import annotations

from corpuscle.llm import winnowing
from corpuscle.llm.registry import query, table


@query("op3_fingerprints")
def op3_fingerprints(spark, sf_dir):
    return winnowing.compared(table(spark, sf_dir, "documents"))
