"""Connected components by minimum labels with pointer jumping, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kanon.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; ``comp`` is the smallest node reachable.

    Each round takes the least label among the neighbours and then the label's own label, so chains halve.
    Rounds end when no label changes; every round is written once to the shared folder.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "c").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        after = written(step.join(jump, "low", "left").select("node", F.col("comp").alias("was"), F.least("low", "far").alias("comp")), "labels")
        labels = after.select("node", "comp")
        if after.where("was <> comp").isEmpty():
            return labels
