"""Connected components by smallest labels, with jumps to the label's own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import scratch


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for all nodes of the edges ``a, b`` (longs); a component's label is its smallest node.

    Every step is a join and a partial minimum, written to the scratch folder. The number of
    steps grows with the logarithm of the longest path.
    """
    both = scratch(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b"), "edges")
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = scratch(
            step.join(jump, "new").select("node", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("moved")),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels
