"""Connected components by joins, for what links of results make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): the smallest node that links reach.

    Each round takes the least label among a node and its neighbours, then the label of that label, so that what one
    sees doubles. Two shuffles a round; a node of very many edges is split by adaptive skew joins.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("least"))
        ahead = least.select(F.col("node").alias("least"), F.col("least").alias("ahead"))
        moved = cut(least.join(ahead, "least").select("node", F.col("label").alias("was"), F.least("least", "ahead").alias("label")))
        if moved.filter("was <> label").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")
