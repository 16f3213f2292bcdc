"""Connected components by repeated minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalframe.llm.store import keep


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node of each node's component.

    Only nodes on an edge between different nodes appear; null ends are ignored.
    Each round sends a node the least label among its neighbours (a partial
    minimum, so a hub's edges are combined before the shuffle) and then replaces
    each label by that label's own label, which halves the distance to the root.
    Rounds end when no label changes. Labels are written to the shared folder in
    each round; nothing is collected but the number of changes.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    both = keep(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                  .select("node", F.least("node", "m").alias("label")))
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        step = (labels.join(near, "node")
                .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        step = keep(step)
        root = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = keep(step.join(root, "label")
                      .select("node", F.col("root").alias("label"), (F.col("root") != F.col("old")).alias("moved")))
        labels = jumped.select("node", "label")
        if jumped.where("moved").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
