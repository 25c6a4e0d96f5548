"""The ordered fold as a stream, in event time: events wait for the watermark, so late files fold as in a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clauseloom.operators.taskstate import FOLD_COLUMNS
from clauseloom.streaming.transitions import OUTCOME_SCHEMA, STATE_SCHEMA, TaskState, as_row, from_row

_COLUMNS = (
    "tenant_id", "task_id", "seq", "ts", "event", "outcome", "status", "attempt", "progress", "error", "dead_letter",
)
#: The outcome of an event that came behind the watermark.
LATE = "late"
_WAITING = "seq long, ts timestamp_ntz, event string, token long, lease_expires_at timestamp_ntz, error_code string"


def _millis(at) -> int:
    """A time without zone on the watermark's scale, which reads it as UTC."""
    return int(pd.Timestamp(at).value // 1_000_000)


def _known(value):
    return None if pd.isna(value) else value


class TaskFold(StatefulProcessor):
    """Keeps the events of a task until the watermark has passed them, then applies them in time order.

    An event that the watermark has already passed when it arrives is too late to be put in order; it changes nothing and comes out with the
    outcome ``late``, so that every input row comes out once.

    State per task: its waiting events (those of the watermark's delay), the folded state, and the time of the last
    applied event. A finished task is forgotten when more than
    ``retention_ms`` of event time pass without an event.
    """

    def __init__(self, leases: bool, retention_ms: int) -> None:
        self._leases, self._retention = leases, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._task = handle.getValueState("task", STATE_SCHEMA)
        self._waiting = handle.getListState("waiting", _WAITING)
        self._last = handle.getValueState("last", "at long")

    def _load(self) -> TaskState:
        return from_row(self._task.get()) if self._task.exists() else TaskState()

    @staticmethod
    def _finished(state: TaskState) -> bool:
        return state.status in ("succeeded", "failed")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, late, watermark = None, [], timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            events = [
                (
                    # A column with gaps arrives as floats; state columns are typed.
                    int(e.seq), e.ts, e.event, None if pd.isna(e.token) else int(e.token), _known(e.lease_expires_at),
                    _known(e.error_code),
                )
                for e in frame.itertuples(index=False)
            ]
            late += [e for e in events if _millis(e[1]) <= watermark]
            events = [e for e in events if _millis(e[1]) > watermark]
            if events:
                self._waiting.appendList(events)
                first = min([e[1] for e in events] + ([] if first is None else [first]))
        if first is not None:
            self._handle.registerTimer(_millis(first))
        if late:
            state = self._load().snapshot()
            out = [(key[0], key[1], seq, ts, event, LATE, *state) for seq, ts, event, *_ in late]
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"seq": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Applies what the watermark has passed. With ``leases``, a running task whose lease has passed is reported as
        reclaimable; a renewed one is not."""
        watermark, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        state, out, rest = self._load(), [], []
        last = self._last.get()[0] if self._last.exists() else None
        if self._waiting.exists():
            events = list(self._waiting.get())
            rest = [e for e in events if _millis(e[1]) > watermark]
            due = sorted((e for e in events if _millis(e[1]) <= watermark), key=lambda e: (e[1], e[0]))
            for seq, ts, event, token, lease, error in due:
                if last is not None and self._finished(state) and _millis(ts) > last + self._retention:
                    state = TaskState()
                last = _millis(ts)
                verdict = state.apply(seq, ts, event, token, lease, error)
                out.append((key[0], key[1], seq, ts, event, verdict, *state.snapshot()))
            if due:
                self._task.update(as_row(state))
                self._last.update((last,))
                if self._leases and state.lease_until is not None:
                    self._handle.registerTimer(_millis(state.lease_until))
                if self._finished(state):
                    self._handle.registerTimer(last + self._retention)
                if rest:
                    self._waiting.put(rest)
                    self._handle.registerTimer(min(_millis(e[1]) for e in rest))
                else:
                    self._waiting.clear()
        if self._leases and state.status == "running" and state.lease_until is not None and fired == _millis(state.lease_until):
            out.append((key[0], key[1], None, state.lease_until, "lease", "lease_expired", *state.snapshot()))
        if last is not None and not rest and self._finished(state) and fired >= last + self._retention:
            self._task.clear()
            self._last.clear()
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def fold_stream(
    events: DataFrame, delay: str = "10 minutes", leases: bool = False, retention_hours: int = 24 * 7
) -> DataFrame:
    """Streaming ``events`` → verdict per event, like ``operators.taskstate.fold_events``.

    Events up to ``delay`` behind the newest one are put in order, whatever micro-batch they come in; later ones come out as ``late``. A verdict is given once the watermark has passed its event. ``leases`` also reports expired leases.
    """
    at = F.expr("cast(convert_timezone('UTC', current_timezone(), ts) as timestamp)")
    # The marked column ends here: the watermark goes on, but the engine does not drop late rows, which the processor is to report.
    keyed = events.select(*FOLD_COLUMNS).withColumn("event_time", at).withWatermark("event_time", delay).select(*FOLD_COLUMNS)
    return keyed.groupBy("tenant_id", "task_id").transformWithStateInPandas(
        statefulProcessor=TaskFold(leases, retention_hours * 3_600_000), outputStructType=OUTCOME_SCHEMA,
        outputMode="Append", timeMode="EventTime",
    )


def write_outcomes(outcomes: DataFrame, path: str, checkpoint: str, late_path: str | None = None):
    """Writes verdicts by batch: a replayed batch overwrites its own folder, so effects never repeat. With ``late_path``, late events go to a
    table of their own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("batch_id", F.lit(batch_id))
        tables = [(batch, path)]
        if late_path:
            # The state store must not be asked twice for one batch.
            batch = batch.persist()
            is_late = F.col("outcome") == LATE
            tables = [(batch.filter(~is_late), path), (batch.filter(is_late), late_path)]
        for rows, target in tables:
            rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        batch.unpersist()

    return (
        outcomes.writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
