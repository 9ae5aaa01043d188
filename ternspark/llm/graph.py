"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; a component is named by its smallest node.

    Each round a node takes the smallest label among itself and its neighbours, then its label's label
    (pointer jumping), until nothing changes. Labels are written to the shared folder each round. Minima
    are partially aggregated and joins are plain equi-joins, so a hub is split like any skewed join key.
    """
    both = written(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a))).where("node <> other").distinct(), "links")
    # the first round needs no labels: every node is its own
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component"))
    while True:
        labels = written(labels, "labels")
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = written(lower.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component")), "step")
        if step.where("component <> old").isEmpty():
            return labels
        labels = step.select("node", "component")
