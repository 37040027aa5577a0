"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reachable.

    Labels only fall; each round takes the smallest label among neighbours and
    then the label's own label, so long chains halve. Every round is one
    written table. Loops and repeated edges are harmless.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = scratch.save(labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), f"{name}-near-{step}")
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("top"))
        jumped = scratch.save(lower.join(up, "component", "left").select("node", "old", F.least("component", "top").alias("component")), f"{name}-{step}")
        changed = jumped.filter("component <> old").limit(1).count()
        scratch.drop(f"{name}-near-{step}", f"{name}-{step - 1}")
        labels = jumped.select("node", "component")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
