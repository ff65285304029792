"""Which rows hang together, for a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .sizing import join_facts, settled


def label_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` for all ``nodes``: root is the smallest node that the links (``u, v``) reach from it.

    In each round a node takes the least root of itself and its neighbours, and then the root of that root, so
    that roots travel twice as far in every round.  Minima are combined before each shuffle.
    """
    both = settled(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settled(nodes.select("node", F.col("node").alias("root")).distinct())
    while True:
        beside = both.join(labels, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "root")
        least = labels.unionByName(beside).groupBy("node").agg(F.min("root").alias("near"))
        above = labels.select(F.col("node").alias("near"), "root")
        new = settled(join_facts(least, above, ["near"], ["node"], 8).select("node", F.least("near", "root").alias("root")))
        moved = new.join(labels.withColumnRenamed("root", "was"), "node").where("root < was")
        labels = new
        if moved.isEmpty():
            return labels
