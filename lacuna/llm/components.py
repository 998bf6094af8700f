"""Connected components of a link table, by least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links`` (two long columns) to ``(node, component)``, component = least node reachable.

    Every round takes the least label among neighbours, then the label of that label; paths halve, so rounds
    grow with the logarithm of the longest path. All joins have plain exchanges on both sides, so that
    adaptive execution splits hubs. Self links and repeated links do no harm; nulls are dropped; an empty
    table gives an empty result. Nothing but one count per round reaches the driver.
    """
    spark = links.sparkSession
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    edges = settle(both.union(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = settle(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("y"), F.col("component").alias("near"))
        least = edges.join(seen, "y").groupBy(F.col("x").alias("node")).agg(F.min("near").alias("near"))
        pulled = settle(labels.join(least, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), "pulled")
        jump = pulled.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = settle(pulled.join(jump, "component").select("node", "old", F.least("component", "further").alias("component")), "jumped")
        changed = new.where("old <> component").limit(1).count()
        discard(spark, pulled)
        discard(spark, labels)
        labels = new.select("node", "component")
        if not changed:
            discard(spark, edges)
            return labels
