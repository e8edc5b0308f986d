"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.storage import materialise


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each node's component, for the nodes of edges (a, b).

    Every round takes the smallest label among a node's neighbours and then the label of that label, so the rounds grow with
    the logarithm of a component's diameter.  Labels are written to the shared folder each round; only a count of changes
    comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = materialise(both.where("a != b").distinct())
    labels = materialise(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        lower = materialise(lower)
        roots = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = materialise(lower.join(roots, "label", "left").select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label")))
        changed = jumped.where("label != old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
