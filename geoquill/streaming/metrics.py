"""Request metrics as Structured Streaming: counters, histograms, rates, and their exposition text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counters(requests: DataFrame, by: list[str]) -> DataFrame:
    """Running count per label set; works on streams (complete or update mode) and on tables."""
    return requests.groupBy(*by).agg(F.count("*").alias("n"))


def histogram(requests: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets, sum and count per label set, one pass and one row each."""
    cells = [F.count_if(F.col(value) <= b).alias(f"le_{k}") for k, b in enumerate(bounds)]
    return requests.groupBy(*by).agg(*cells, F.sum(value).alias("total"), F.count("*").alias("n"))


def rate(requests: DataFrame, by: list[str], ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests per window, with a watermark so that a stream's state stays bounded."""
    w = requests.withWatermark(ts, late) if requests.isStreaming else requests
    return w.groupBy(*by, F.window(ts, window).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "n")


def quantile(rows: DataFrame, bounds: list[float], q: float) -> DataFrame:
    """A quantile from cumulative buckets by linear interpolation inside the bucket that holds it."""
    need = F.col("n") * q
    at, low, base = F.lit(None).cast("double"), 0.0, F.lit(0)
    found = []
    for k, b in enumerate(bounds):
        have = F.col(f"le_{k}")
        found.append(F.when(have >= need, F.lit(low) + (b - low) * (need - base) / F.greatest(have - base, F.lit(1))))
        low, base = b, have
    return rows.withColumn("quantile", F.coalesce(*found, F.lit(bounds[-1]), at))


def exposition(counts: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """One line of exposition text per row: name{label="value",...} n."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels])
    return counts.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col("n").cast("string")).alias("line"))


def alert_spans(windows: DataFrame, by: list[str], step_s: int, hold: int) -> DataFrame:
    """Runs of at least ``hold`` consecutive firing windows. ``windows``: by, at (seconds, multiples of step_s), firing."""
    from pyspark.sql.window import Window

    rows = windows.where("firing")
    island = F.col("at") / step_s - F.row_number().over(Window.partitionBy(*by).orderBy("at"))
    spans = rows.withColumn("island", island.cast("long")).groupBy(*by, "island").agg(F.min("at").alias("since"), F.max("at").alias("until"), F.count("*").alias("held"))
    return spans.where(F.col("held") >= hold).drop("island")
