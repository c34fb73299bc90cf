"""Relational steps of the build: deterministic firsts, modes, ladders, anti-joins, range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per group in a total order: distinct with a defined winner."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def mode(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent value per group, ties by the lexically least; counted before anything is ranked."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return first_by(n, by, [F.desc("n"), F.asc(value)])


def range_join(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points in closed ranges, joined on buckets of ``width`` that each range lists."""
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    return p.join(r, "_b").where(F.col(at).between(F.col(lo), F.col(hi))).drop("_b")


def first_non_empty(rungs: list, queries: DataFrame, key: str) -> DataFrame:
    """Rungs in order, each run only for queries that none before answered; ``rung`` says which one did."""
    left, out = queries, None
    for k, rung in enumerate(rungs):
        got = rung(left).withColumn("rung", F.lit(k))
        out = got if out is None else out.unionByName(got)
        if k + 1 < len(rungs):
            left = left.join(got.select(key).distinct(), key, "left_anti")
    return out


def sides_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def clusters(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(v, c): for each vertex of ``edges`` (a, b) the least vertex it reaches; labels halve their way by jumps.

    Each round's labels are written to the shared folder, so lineage stays short and lost executors cost nothing.
    """
    from geoquill.sources.shared import kept

    both = kept(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), "edges")
    labels = kept(both.groupBy("v").agg(F.min("w").alias("c")).select("v", F.least("v", "c").alias("c")), "labels")
    for _ in range(most_rounds):
        told = both.join(labels.withColumnRenamed("v", "w"), "w").select("v", "c").unionByName(labels).groupBy("v").agg(F.min("c").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("c2"))
        after = kept(told.join(jump, "c", "left").select("v", F.least("c", F.coalesce("c2", "c")).alias("c")), "labels")
        changed = after.join(labels.withColumnRenamed("c", "was"), "v").where("c <> was").limit(1).count()
        labels = after
        if not changed:
            return labels
    raise RuntimeError("clusters did not settle")
