"""Connected components over edge tables, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.storage import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (src, dst); the label is the smallest node reachable.

    Every round takes the smallest label among neighbours and then jumps to the label of the label, so the number of
    rounds grows with the logarithm of the longest path. Rounds are cut by tables in the shared folder. Neighbours'
    labels are reduced map-side before they meet, so a node with very many edges is no large group.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = materialize(both.filter("src <> dst").distinct(), "edges")
    labels = materialize(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label"))
        .withColumn("label", F.least("node", "label")), "labels",
    )
    while True:
        offered = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"))
        offered = offered.agg(F.min("label").alias("offer"))
        nearest = labels.join(offered, "node").select(
            "node", F.least("label", "offer").alias("near"), (F.col("offer") < F.col("label")).alias("moved")
        )
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        following = materialize(
            nearest.join(jump, "near").select("node", F.least("near", "far").alias("label"), "moved"), "labels",
        )
        if following.filter("moved").isEmpty():
            return following.select("node", "label")
        labels = following.select("node", "label")
