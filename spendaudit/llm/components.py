"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendaudit.session import materialize


def component_labels(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of the edges (a, b).

    Each round takes the smallest label among the neighbours and then the label of that label, so that chains shorten by
    half; rounds go on until nothing changes. Labels and edges stay distributed; a node with a third of all edges is a skewed
    join side, which Spark splits, and its minimum is summed up by task first.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = materialize(both, "edges")
    if not both.limit(1).count():
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(told.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "near").alias("next"))
        nearer = materialize(nearer, "labels")
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        after = nearer.join(jump, "next").select("node", F.least("next", "beyond").alias("new"), "component")
        after = materialize(after, "labels")
        changed = after.filter("new != component").limit(1).count()
        labels = after.select("node", F.col("new").alias("component"))
        if not changed:
            return labels
