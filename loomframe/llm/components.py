"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): component is the smallest node reachable.

    Each round takes the least label among neighbours, then jumps to the label's own label, so a path
    of n nodes needs about log n rounds.  Labels live in checkpointed tables; the driver sees one
    count a round.  No edges give an empty table.  Null ends are left out.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a != b")
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("lower"))
        lower = cut(lower)
        # a label is a node as well, so its own label is no larger
        root = lower.select(F.col("node").alias("root"), F.col("lower").alias("root_label"))
        jumped = cut(lower.join(root, lower.lower == root.root).select("node", "label", F.least("lower", "root_label").alias("next")))
        if not jumped.where("next != label").head(1):
            return jumped.select("node", F.col("next").alias("component"))
        labels = jumped.select("node", F.col("next").alias("label"))
