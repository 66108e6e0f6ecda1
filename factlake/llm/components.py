"""Connected components by smallest-label spreading with pointer jumping, staged between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node of edges (a, b)."""
    both = stage(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        # Spread over edges, then follow each label to its own label.
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        spread = stage(
            labels.join(near.withColumnRenamed("a", "node"), "node").select(
                "node", F.least("label", "m").alias("label"), F.col("label").alias("was")
            ),
            "spread",
        )
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = stage(
            spread.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was"), "moved"
        )
        changed = moved.filter("label != was").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
