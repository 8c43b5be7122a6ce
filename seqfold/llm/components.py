"""Connected components of a graph given as edges, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqfold.llm.storage import kept


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node of its component.

    A round takes the least label of a node's neighbours, then the label of that label, so that chains
    shorten to their logarithm and the stars that the callers build end after two rounds. Labels are
    gathered with min, which is combined before the shuffle; joins are on a node and can be split where
    one node has very many edges. Each round is written to the shared folder. Edges with a null are
    ignored; repeated edges and loops are harmless; no edges give no rows."""
    spark = edges.sparkSession
    edges = edges.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = kept(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = kept(lower.join(jump, "next").select("node", F.least("next", "far").alias("new"), "label"))
        changed = step.where("new <> label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds on {spark.sparkContext.applicationId}")
