"""Streaming queries, run to the end of what there is, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquill.sources import shared
from geoquill.streaming import gates, metrics

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def wrap(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


def _events(spark, sf):
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).parquet(path + "*")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark, df, mode: str):
    """Run a stream over everything available; its last complete result, or all appended rows, as a table."""
    root = shared.folder(spark, "stream")
    # a batch that runs again overwrites what it wrote; a complete result replaces the last one
    each = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out" + ("" if mode == "complete" else f"/batch={n}"))
    df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out").select(*df.columns)


@query("a16_request_counter", "select event_type as endpoint, count(*) as n from events group by 1")
def a16(spark, sf):
    return drained(spark, metrics.counters(_events(spark, sf).withColumnRenamed("event_type", "endpoint"), ["endpoint"]), "complete")


@query("st10_histogram", "select event_type as endpoint, count(*) filter (value<=10) as le_0, count(*) filter (value<=50) as le_1, count(*) filter (value<=100) as le_2, round(sum(value),2) as total, count(*) as n from events group by 1")
def st10(spark, sf):
    h = metrics.histogram(_events(spark, sf).withColumnRenamed("event_type", "endpoint"), ["endpoint"], "value", [10.0, 50.0, 100.0])
    return drained(spark, h, "complete").withColumn("total", F.round("total", 2))


@query("st11_rates", "select event_type as endpoint, time_bucket(interval 1 hour, ts) as start, count(*) as n from events group by 1,2")
def st11(spark, sf):
    r = metrics.rate(_events(spark, sf).withColumnRenamed("event_type", "endpoint"), ["endpoint"], window="1 hour")
    return drained(spark, r, "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("st09_throttle", "with recursive k(u, w) as (select user_id, min(ts) from events group by 1 union all select u, (select min(e.ts) from events e where e.user_id=u and e.ts >= w + interval 12 hours) from k where w is not null) select cast(u as varchar) as key, w as ts from k where w is not null")
def st09(spark, sf):
    out = drained(spark, gates.throttle(_events(spark, sf), "user_id", "ts", 12 * 3600), "append")
    return out.select("key", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"))


@query("st05_token_bucket", "with recursive e as (select user_id u, event_id, epoch_us(ts) t, row_number() over (partition by user_id order by ts, event_id) n from events), r(u, n, event_id, t, level, sent) as (select u, n, event_id, t, 2.0::double, true from e where n=1 union all select e.u, e.n, e.event_id, e.t, x.l - case when x.l >= 1 then 1 else 0 end, x.l >= 1 from r join e on e.u=r.u and e.n=r.n+1, lateral (select least(3.0::double, r.level + greatest(0, e.t-r.t)/1e6::double*(1::double/3600)) l) x) select cast(u as varchar) as key, event_id, sent from r")
def st05(spark, sf):
    return drained(spark, gates.token_bucket(_events(spark, sf), "user_id", "ts", 1 / 3600, 3), "append")


@query("st04_bounded_queue", SQL["st05_token_bucket"].replace("2.0::double, true", "1.0::double, true").replace("least(3.0::double", "least(2.0::double").replace("(1::double/3600)", "(1::double/7200)").replace("event_id, sent from r", "event_id, sent as queued from r"))
def st04(spark, sf):
    """Places for two, one worked off every two hours: who finds none is dropped."""
    return drained(spark, gates.bounded_queue(_events(spark, sf), "user_id", "ts", 2, 1 / 7200), "append")


@query("st03_sample", "select event_id from events where ('0x' || left(md5(cast(event_id as varchar)),8))::bigint < 0.1*4294967296")
def st03(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").where(gates.sampled(F.col("event_id"), 0.1)).select("event_id")


@query("st02_latest_versions", "with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) select user_id, event_id, event_type from r where rn=1")
def st02(spark, sf):
    """Replicated edits: the last version of each key, pre-aggregated."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    m = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return m.select("user_id", "m.event_id", "m.event_type")


@query("st13_alert_hold", "with w as (select event_type e, cast(floor(epoch(ts)/3600)*3600 as bigint) w, count(*) n from events group by 1,2), f as (select *, w/3600-row_number() over (partition by e order by w) i from w where n>=4) select e as endpoint, min(w) as since, max(w) as until, count(*) as held from f group by e, i having count(*)>=3")
def st13(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    at = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).cast("long")
    w = e.groupBy(F.col("event_type").alias("endpoint"), at.alias("at")).agg(F.count("*").alias("n")).withColumn("firing", F.col("n") >= 4)
    return metrics.alert_spans(w, ["endpoint"], 3600, 3)


@query("sk12_exposition", "select concat('requests_total{endpoint=\"', event_type, '\"} ', count(*)) as line from events group by event_type")
def sk12(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_type", "endpoint")
    return metrics.exposition(metrics.counters(e, ["endpoint"]), "requests_total", ["endpoint"])


@query("a19_p99", "with h as (select event_type e, count(*) n, count(*) filter (value<=10) a, count(*) filter (value<=50) b, count(*) filter (value<=100) c from events group by 1) select e as endpoint, round(case when a>=n*0.9 then 0+10*(n*0.9-0)/greatest(a,1) when b>=n*0.9 then 10+40*(n*0.9-a)/greatest(b-a,1) when c>=n*0.9 then 50+50*(n*0.9-b)/greatest(c-b,1) else 100 end,4) as quantile from h")
def a19p(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_type", "endpoint")
    h = metrics.histogram(e, ["endpoint"], "value", [10.0, 50.0, 100.0])
    return metrics.quantile(h, [10.0, 50.0, 100.0], 0.9).select("endpoint", F.round("quantile", 4).alias("quantile"))
