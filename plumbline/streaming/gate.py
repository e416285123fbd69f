"""A gate of requests: a token bucket, a monthly quota and a state machine for each key, over a table or a stream.

The stream keeps its state with transformWithState: values for bucket, quota and status, a list of requests that wait for
the watermark, and timers that wake them. Requests are decided in the order of (ts, event_id) once the watermark has
passed them, so the answers do not depend on how micro-batches cut or shuffle the stream, and are those of the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from plumbline.streaming.limits import consume

DECISION = (
    "key string, event_id long, ts double, allowed boolean, retry_after double, remaining double, granted boolean, quota_remaining long, accepted boolean, status string"
)

#: The state store that lists and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    """capacity and rate (tokens a second) of the bucket; limit of granted requests a month; status at first, and the
    statuses that may follow each; idle: seconds after which a bucket is forgotten, and so full again."""

    capacity: float
    rate: float
    limit: int
    first: str
    moves: Mapping[str, Sequence[str]]
    idle: float = 600.0


@dataclass
class Standing:
    """What a key has used up: tokens and time of its bucket, requests granted in a month, status."""

    tokens: float
    last: float | None = None
    month: str = ""
    used: int = 0
    status: str = ""
    rules: Rules = field(default=None, repr=False)

    def decide(self, ts: float, to: str | None) -> tuple:
        """The bucket first; what it lets through counts against the quota; what that grants may change the status.

        A null `to` asks for no change. quota_remaining is what the month has left after the request."""
        r = self.rules
        if self.last is None or ts - self.last > r.idle:
            self.tokens, self.last = r.capacity, ts
        ((allowed, retry_after, remaining),), self.tokens, self.last = consume([ts], self.tokens, self.last, r.capacity, r.rate)
        month = datetime.fromtimestamp(ts, timezone.utc).strftime("%Y-%m")
        if month != self.month:
            self.month, self.used = month, 0
        granted = allowed and self.used < r.limit
        self.used += granted
        accepted = bool(granted and to is not None and to in r.moves.get(self.status, ()))
        if accepted:
            self.status = to
        return allowed, retry_after, remaining, granted, r.limit - self.used, accepted, self.status


def new(rules: Rules) -> Standing:
    return Standing(rules.capacity, status=rules.first, rules=rules)


def decided(events: DataFrame, rules: Rules, partitions: int) -> DataFrame:
    """events (key, event_id, ts in seconds, to) with the gate's answers. A task walks its keys in order and holds one
    standing, so a key with most events need not fit in memory. A null key is a key of its own, the empty one."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, standing = None, new(rules)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.key != key:
                    key, standing = row.key, new(rules)
                out.append((row.key, row.event_id, row.ts, *standing.decide(row.ts, row.to)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])

    rows = events.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("double").alias("ts"), F.col("to").cast("string").alias("to"))
    return rows.repartition(partitions, "key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(walk, DECISION)


class Gate(StatefulProcessor):
    """The stream's form of decided()."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last double")
        self.quota = handle.getValueState("quota", "month string, used int")
        self.status = handle.getValueState("status", "status string")
        self.waiting = handle.getListState("waiting", "event_id long, ts double, `to` string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        come = [(r.event_id, r.ts, r.to) for r in rows]
        self.waiting.appendList(come)
        for at in {self.due(ts) for _, ts, _ in come}:
            self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        ripe = sorted((x for x in waiting if self.due(x[1]) <= now), key=lambda x: (x[1], x[0]))
        if ripe:
            left = [x for x in waiting if self.due(x[1]) > now]
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
            standing = self.standing()
            for event_id, ts, to in ripe:
                yield Row(key=key[0], event_id=event_id, ts=ts, **dict(zip(("allowed", "retry_after", "remaining", "granted", "quota_remaining", "accepted", "status"), standing.decide(ts, to), strict=True)))
            self.keep(standing)
            self.handle.registerTimer(self.due(standing.last + self.rules.idle) + 1)
        elif self.bucket.exists() and now > self.due(self.bucket.get()[1] + self.rules.idle):
            self.bucket.clear()  # idle: the next request finds a full one

    def due(self, ts: float) -> int:
        """The time, in whole milliseconds, from which a request at ts is not late any more."""
        return int(ts * 1000) + 1

    def standing(self) -> Standing:
        out = new(self.rules)
        if self.bucket.exists():
            out.tokens, out.last = self.bucket.get()
        if self.quota.exists():
            out.month, out.used = self.quota.get()
        if self.status.exists():
            (out.status,) = self.status.get()
        return out

    def keep(self, standing: Standing) -> None:
        self.bucket.update((standing.tokens, standing.last))
        self.quota.update((standing.month, standing.used))
        self.status.update((standing.status,))

    def close(self) -> None:
        pass


def decided_stream(events: DataFrame, rules: Rules, late: str = "10 minutes") -> DataFrame:
    """decided() over a stream. Answers come once the watermark, which trails the latest ts by `late`, has passed a
    request; requests behind it are dropped. Sets the session's state store to one that holds lists and timers."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("double").alias("ts"), F.col("to").cast("string").alias("to"))
    rows = rows.withColumn("at", F.timestamp_seconds(F.col("ts") + 1)).withWatermark("at", late)  # what is at 0 counts as late
    return rows.groupBy("key").transformWithState(Gate(rules), DECISION, "Append", "EventTime")
