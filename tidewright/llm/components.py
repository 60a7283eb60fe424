"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of ``links``; component = smallest node.

    Links and labels stay in tables of the shared folder.  A round takes the
    smallest label among the neighbours (aggregated before the shuffle, so a
    node with very many links is no hot spot) and then jumps to the label's own
    label; rounds follow the logarithm of the longest chain.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = keep(both.union(both.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = keep(labels.select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        nearest = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("m"))
        )
        lower = labels.join(nearest, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "m").alias("via")
        )
        jumped = lower.join(labels.select(F.col("node").alias("via"), F.col("component").alias("c")), "via")
        new = keep(jumped.select("node", "was", F.least("via", "c").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels
