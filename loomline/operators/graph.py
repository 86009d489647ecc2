"""Connected components by the smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.cut import written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of nodes (node) and edges (a, b): the smallest node that can be reached. Every round takes the
    least label among the neighbours, then the label of that label, and is written once."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = nodes.select("node").distinct().withColumn("component", F.col("node"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("far"))
        after = written(step.join(jump, "component", "left").select("node", "old", F.coalesce("far", "component").alias("component")), "labels")
        if after.where("old <> component").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
