"""Notification delivery as streams: duplicates dropped, malformed payloads told apart, metrics by window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clauseloom.sources import notifications


def deduplicated(events: DataFrame, horizon: str = "10 minutes") -> DataFrame:
    """At-least-once input → each ``(tenant_id, event_id)`` once; state is dropped after the watermark horizon."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["tenant_id", "event_id"])


def split_notifications(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-formed notifications and the malformed payloads."""
    parsed = notifications.parse(raw)
    return parsed.filter("NOT malformed").drop("malformed"), parsed.filter("malformed").select("payload")


def outcome_windows(events: DataFrame, width: str = "1 hour", horizon: str = "10 minutes") -> DataFrame:
    """Events per tenant, kind and tumbling window, finished when the watermark passes."""
    counted = events.withWatermark("ts", horizon).groupBy(F.window("ts", width), "tenant_id", "event")
    return counted.agg(F.count("*").alias("events")).select(
        F.col("window.start").alias("window_start"), "tenant_id", "event", "events"
    )



# --- deliveries that nobody acknowledges -----------------------------------------------------------

IDLE_SCHEMA = "tenant_id string, event_id string, idle_since timestamp_ntz, reclaim_no long"


def _millis(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


class IdleDeliveries(StatefulProcessor):
    """Pending deliveries of a tenant's shard in a map state, one timer each.

    ``deliver`` (and every later one of the same event) sets when a delivery was last seen, ``ack`` takes it away. When the watermark has passed its last
    sight by the idle time it is reported, counts as seen at that moment, and waits again: every delivery has its own timer, so none is
    kept from its turn by others, however many there are. A delivery that has been reported ``reports`` times is given up.
    """

    def __init__(self, idle_ms: int, reports: int) -> None:
        self._idle, self._reports = idle_ms, reports

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getMapState("pending", "event_id string", "seen long, reports long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Rows of one batch come in any order; of one event the latest counts, and an acknowledgement last of all at one time.
        latest: dict[str, tuple[int, bool]] = {}
        for frame in rows:
            for e in frame.itertuples(index=False):
                at = (_millis(e.ts), e.action == "ack")
                latest[e.event_id] = max(latest.get(e.event_id, at), at)
        for event, (at, acknowledged) in latest.items():
            held = self._pending.getValue((event,)) if self._pending.containsKey((event,)) else None
            if held is not None and held[0] > at:
                continue
            if acknowledged:
                if held is not None:
                    self._pending.removeKey((event,))
            else:
                self._pending.updateValue((event,), (at, 0 if held is None else held[1]))
                self._handle.registerTimer(at + self._idle)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, out = expiredTimerInfo.getExpiryTimeInMs(), []
        # A timer stands for all deliveries of the shard that were last seen at one moment; changed ones have a later timer.
        due = [(event[0], seen, reports) for event, (seen, reports) in self._pending.iterator() if seen + self._idle == fired]
        for event, seen, reports in sorted(due):
            out.append((key[0], event, pd.Timestamp(seen, unit="ms"), reports + 1))
            if reports + 1 >= self._reports:
                self._pending.removeKey((event,))
            else:
                self._pending.updateValue((event,), (fired, reports + 1))
                self._handle.registerTimer(fired + self._idle)
        if out:
            yield pd.DataFrame(out, columns=["tenant_id", "event_id", "idle_since", "reclaim_no"])

    def close(self) -> None:
        pass


def idle_deliveries(log: DataFrame, idle: int = 60_000, delay: str = "1 minute", reports: int = 3, shards: int = 64) -> DataFrame:
    """Streaming ``log(tenant_id, event_id, action, ts)`` of ``deliver`` and ``ack`` → deliveries that were idle for ``idle`` milliseconds.

    A tenant's deliveries are spread over ``shards`` by their id, so that a tenant with a third of all deliveries is many states.
    """
    at = F.expr("cast(convert_timezone('UTC', current_timezone(), ts) as timestamp)")
    shard = F.pmod(F.xxhash64("event_id"), F.lit(shards))
    keyed = log.select("tenant_id", shard.alias("shard"), "event_id", "action", "ts", at.alias("event_time")).withWatermark("event_time", delay)
    return keyed.groupBy("tenant_id", "shard").transformWithStateInPandas(
        statefulProcessor=IdleDeliveries(idle, reports), outputStructType=IDLE_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
