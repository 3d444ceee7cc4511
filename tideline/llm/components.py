"""Connected components of a graph in tables: minimum labels with pointer jumping, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component, old) for ``edges(a, b)`` of one orderable type: component is the least node reachable.

    Each round takes the least label around a node and then the label's own label, so the rounds grow with the
    logarithm of the longest path. Labels live in tables; only a count of changes reaches the driver.
    """
    both = edges.select(F.col("a"), F.col("b")).where("a <> b")
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.lit(None).cast(both.schema["a"].dataType).alias("old"), F.least("a", "m").alias("component")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        least = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("now"))
        least = stored(least, "labels")
        jump = least.select(F.col("node").alias("now"), F.col("now").alias("root"))
        jumped = stored(least.join(jump, "now").select("node", "old", F.col("root").alias("component")), "labels")
        changed = jumped.where("component <> old").limit(1).count()
        discard(labels, least)
        labels = jumped
        if not changed:
            discard(both)
            return labels
