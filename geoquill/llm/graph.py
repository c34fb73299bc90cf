"""Connected components of an edge table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, c): for each vertex of ``edges`` (a, b) the least vertex that it reaches.

    Each round takes the least label among the neighbours, pre-aggregated, then follows labels one jump; it ends when
    nothing changes. Every round's labels are written to the shared folder.
    """
    both = stored(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), "edges")
    labels = stored(both.groupBy("v").agg(F.min("w").alias("c")).select("v", F.least("v", "c").alias("c")), "labels")
    previous = labels
    for _ in range(most_rounds):
        told = both.join(labels.select(F.col("v").alias("w"), "c"), "w").select("v", "c")
        least = told.unionByName(labels.select("v", "c")).groupBy("v").agg(F.min("c").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("c2"))
        after = least.join(jump, "c", "left").select("v", F.least("c", F.coalesce("c2", "c")).alias("c"))
        after = stored(after.join(labels.select("v", F.col("c").alias("was")), "v"), "labels")
        changed = after.where("c <> was").limit(1).count()
        forget(previous)
        previous, labels = after, after.select("v", "c")
        if not changed:
            forget(both)
            return labels
    raise RuntimeError("components did not settle")
