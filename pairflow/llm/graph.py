"""Connected components of a link table, as joins and aggregates with stored steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.workspace import materialize


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over links, for nodes that have a link.

    Each round takes the smallest label around a node, then the label of that label. A node with very many
    links costs no more than its rows: labels meet links in joins that can be split, and minima combine
    before the shuffle. Steps are written to the shared folder.
    """
    one_way = links.select(F.col(left).alias("node"), F.col(right).alias("other"))
    edges = materialize(one_way.unionByName(one_way.select(F.col("other").alias("node"), F.col("node").alias("other"))), "links")
    labels = materialize(
        edges.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")),
        "labels")
    while True:
        around = (edges.join(labels.withColumnRenamed("node", "other"), "other")
                  .groupBy("node").agg(F.min("component").alias("m")))
        nearer = labels.join(around, "node").select(
            "node", F.least("component", "m").alias("near"), F.col("component").alias("old"))
        over = labels.select(F.col("node").alias("near"), F.col("component").alias("next"))
        step = materialize(
            nearer.join(over, "near").select("node", F.least("near", "next").alias("component"), "old"), "labels")
        labels = step.select("node", "component")
        if step.filter("component <> old").isEmpty():
            return labels
