"""Rates, quotas and caches over event streams, each in a batch and a streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

BUCKET = "key string, event_id long, ts double, allowed boolean, retry_after double, remaining double"
STATE = "tokens double, last_refill double"


def consume(times: list[float], tokens: float, last: float, capacity: float, rate: float) -> tuple[list[tuple[bool, float, float]], float, float]:
    """One call to a token bucket at each time: (allowed, retry_after, remaining), and the bucket after them."""
    out = []
    for now in times:
        if now > last:
            tokens, last = min(capacity, tokens + (now - last) * rate), now
        if tokens >= 1.0:
            tokens -= 1.0
            out.append((True, 0.0, tokens))
        else:
            out.append((False, (1.0 - tokens) / rate, tokens))
    return out, tokens, last


def token_bucket(events: DataFrame, capacity: float, rate: float, partitions: int) -> DataFrame:
    """events (key, event_id, ts in seconds) with what a bucket of each key says, in the order of (ts, event_id).

    A task walks its keys in order and holds one bucket, so that a key with most events does not have to fit in
    memory."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = None, capacity, 0.0
        for batch in batches:
            parts = []
            for k, group in batch.groupby("key", sort=False, dropna=False):
                if k != key:
                    key, tokens, last = k, capacity, float(group["ts"].iloc[0])
                said, tokens, last = consume(group["ts"].tolist(), tokens, last, capacity, rate)
                parts.append(group.assign(allowed=[s[0] for s in said], retry_after=[s[1] for s in said], remaining=[s[2] for s in said]))
            if parts:
                yield pd.concat(parts)[["key", "event_id", "ts", "allowed", "retry_after", "remaining"]]

    rows = events.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "event_id", F.col("ts").cast("double").alias("ts"))
    return rows.repartition(partitions, "key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(walk, BUCKET)


def token_bucket_stream(events: DataFrame, capacity: float, rate: float, idle_seconds: float = 600.0, late: str = "10 minutes") -> DataFrame:
    """The same over a stream. A key's bucket is dropped once the watermark is idle_seconds past its last event; the
    watermark trails the latest ts by late, and events behind it are dropped, as are those of a negative ts."""

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        tokens, last = state.get if state.exists else (capacity, float(rows["ts"].iloc[0]))
        said, tokens, last = consume(rows["ts"].tolist(), tokens, last, capacity, rate)
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int((last + 1 + idle_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(key=key[0], allowed=[s[0] for s in said], retry_after=[s[1] for s in said], remaining=[s[2] for s in said])[["key", "event_id", "ts", "allowed", "retry_after", "remaining"]]

    rows = events.select(F.col("key").cast("string").alias("key"), "event_id", F.col("ts").cast("double").alias("ts"))
    rows = rows.withColumn("at", F.timestamp_seconds(F.col("ts") + 1)).withWatermark("at", late)  # what is at 0 counts as late
    return rows.groupBy("key").applyInPandasWithState(step, BUCKET, STATE, "append", "EventTimeTimeout")


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in each window of time; works on tables and, with a watermark, on streams."""
    rows = events.withColumn("t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("t", late)
    out = rows.groupBy(F.window("t", width), by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), by, "n")
