"""Connected components over a links table, by least-label propagation with pointer jumping.

Each round is two equi-joins and a partially aggregated minimum; labels are written to the shared folder
after it, so lineage stays short and a lost executor repeats one round at most. Nothing goes to the driver
but whether a label changed; a round's folders are deleted when the next one's stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) of equal type -> (node, component), the least node reachable; nodes without links are absent."""
    both = links.where("a is not null and b is not null and a <> b")
    both = written(both.select("a", "b").union(both.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        )
        told = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        told = written(told, "told")
        up = told.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        new = written(told.join(up, "component").select("node", "old", F.least("component", "upper").alias("component")), "labels")
        discard(told, labels)
        labels = new
        if labels.where("old <> component").isEmpty():
            discard(both)
            return labels.select("node", "component")
