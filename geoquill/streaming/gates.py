"""Gates for mirrored requests: sampling, throttle, token bucket, caps; as batch expressions and as keyed state."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

log = logging.getLogger(__name__)


def sampled(key: Column, share: float) -> Column:
    """Deterministic sampling by a hash of the key: the same request is always in or out."""
    return F.conv(F.left(F.md5(key.cast("string").cast("binary")), F.lit(8)), 16, 10).cast("double") < share * 2**32


def throttle(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """First event of each key, then the first at least ``seconds`` after the last one let through. A table or a stream.

    Between batches a key's state is one number; inside a batch its rows are sorted, so one key's rows of one batch must fit
    a task. State stays for every key ever seen: one number each.
    """

    def step(keys, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        keep = []
        for at, event in zip(rows["at"], rows["event_id"], strict=True):
            if last is None or at >= last + seconds * 1_000_000:
                keep.append((keys[0], event, at))
                last = at
        state.update((int(last),))
        yield pd.DataFrame(keep, columns=["key", "event_id", "at"])

    rows = events.select(F.col(key).cast("string").alias("key"), "event_id", F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, event_id long, at long", "last long", "append", GroupStateTimeout.NoTimeout)


def token_bucket(events: DataFrame, key: str, ts: str, per_second: float, burst: float) -> DataFrame:
    """(key, event_id, sent): a bucket per key refills with time and pays one token for each event sent.

    State stays for every key ever seen: two numbers each.
    """

    def step(keys, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, then = state.get if state.exists else (burst, None)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = []
        for at, event in zip(rows["at"], rows["event_id"], strict=True):
            if then is not None:
                level = min(burst, level + max(0, at - then) / 1e6 * per_second)
            then = at
            sent = level >= 1
            level -= sent
            out.append((keys[0], event, bool(sent)))
        state.update((float(level), int(then)))
        yield pd.DataFrame(out, columns=["key", "event_id", "sent"])

    rows = events.select(F.col(key).cast("string").alias("key"), "event_id", F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, event_id long, sent boolean", "level double, at long", "append", GroupStateTimeout.NoTimeout)


def bounded_queue(events: DataFrame, key: str, ts: str, capacity: int, per_second: float) -> DataFrame:
    """(key, event_id, queued): a queue per key that is worked off at a rate and drops what finds it full.

    Its free places are a bucket's tokens: they come back as work is done, and each event that is taken uses one.
    """
    return token_bucket(events, key, ts, per_second, float(capacity)).withColumnRenamed("sent", "queued")


#: Fixed value: requests a day that are mirrored at most, whatever is configured.
DAILY_MOST = 100_000


def daily_cap(events: DataFrame, ts: str, cap: int) -> DataFrame:
    """``events`` with sent: whether they are among the first of their UTC day. Each task keeps only its first ``cap`` of a day."""
    day, most = F.date_trunc("day", ts), min(cap, DAILY_MOST)
    w = Window.partitionBy("_day").orderBy(ts, "event_id")
    first = events.select("event_id", ts, day.alias("_day")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    return events.join(first.select("event_id", F.lit(True).alias("sent")), "event_id", "left").withColumn("sent", F.coalesce("sent", F.lit(False)))


def outcome(gate: Column, status: Column, axes: list[Column], metres: Column) -> Column:
    """One of nine outcomes of a mirrored request. ``gate``: why it was not sent, or null; ``status``: of the answer.

    ``axes`` are comparisons, null where a side is unknown; a distance beyond 1 km is a mismatch.
    """
    compared, differs = metres.isNotNull(), F.coalesce(metres > 1000, F.lit(False))
    for a in axes:
        compared, differs = compared | a.isNotNull(), differs | F.coalesce(~a, F.lit(False))
    sent = F.when(status == "timeout", "timeout").when(status != "ok", "external_error").when(~compared, "zero_results").when(differs, "mismatch").otherwise("match")
    return F.when(gate.isin("auth_disabled", "daily_cap_hit", "queue_full", "rate_limited"), gate).otherwise(sent)


def reloading(stream: DataFrame, load, join, sink):
    """A stream joined with a table that is loaded anew whenever its marker changes; a failed load keeps the last one.

    ``load(old)`` returns (marker, table) or raises; ``join(batch, table)`` and ``sink(result, batch_id)`` do the rest.
    """
    held: dict = {"table": None, "marker": None}

    def each(batch: DataFrame, batch_id: int) -> None:
        try:
            held["marker"], held["table"] = load(held["marker"], held["table"])
        except Exception:  # serving goes on with what is held
            if held["table"] is None:
                raise
            log.warning("the table could not be loaded anew; the last one stays", exc_info=True)
        sink(join(batch, held["table"]), batch_id)

    return stream.writeStream.foreachBatch(each)
