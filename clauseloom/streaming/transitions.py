"""One task's state and what each event does to it; shared by the batch and the streaming fold."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta

from clauseloom.functions import fixed_values as fv

MAX_ATTEMPTS = 3
BACKOFF_MS = 1_000

STATE_SCHEMA = (
    "status string, attempt long, progress long, error string, dead_letter boolean, token long, "
    "lease_until timestamp_ntz, due timestamp_ntz"
)
OUTCOME_SCHEMA = (
    "tenant_id string, task_id string, seq long, ts timestamp_ntz, event string, outcome string, "
    "status string, attempt long, progress long, error string, dead_letter boolean"
)


def _clean(value):
    """pandas marks a missing value as NaN or NaT."""
    return None if value is None or value != value else value


@dataclass
class TaskState:
    status: str = "queued"
    attempt: int = 0
    progress: int = 0
    error: str | None = None
    dead_letter: bool = False
    token: int | None = None
    lease_until: datetime | None = None
    due: datetime | None = None

    def snapshot(self) -> tuple:
        return (self.status, self.attempt, self.progress, self.error, self.dead_letter)

    def _release(self) -> None:
        self.token, self.lease_until = None, None

    def _due(self, ts: datetime) -> bool:
        if self.status == "queued":
            return self.due is None or self.due <= ts
        return self.status == "running" and self.lease_until <= ts

    def _leased(self, ts: datetime, token) -> bool:
        return self.status == "running" and token == self.token and self.lease_until > ts

    def apply(self, seq, ts, event, token, lease_until, error) -> str:
        """Returns accepted, stale (a writer without the current lease) or rejected."""
        token, error = _clean(token), _clean(error)
        if event == "claim":
            return self._claim(seq, ts, lease_until)
        if event == "retry":
            if self.status != "failed":
                return "rejected"
            self.__init__(due=ts)
            return "accepted"
        if token is None or not self._leased(ts, int(token)):
            return "stale"
        if event == "renew":
            if not lease_until > ts:
                return "rejected"
            self.lease_until = lease_until
        elif event == "complete":
            self.status, self.progress, self.error = "succeeded", 100, None
            self._release()
        elif event == "requeue" and error in fv.TRANSIENT_CODES and self.attempt < MAX_ATTEMPTS:
            delay = BACKOFF_MS * 2 ** min(max(self.attempt - 1, 0), 16)
            self.status, self.progress, self.error = "queued", 0, error
            self.due = ts + timedelta(milliseconds=delay)
            self._release()
        else:
            self.status, self.error, self.dead_letter = "failed", error, True
            self._release()
        return "accepted"

    def _claim(self, seq, ts, lease_until) -> str:
        if self.dead_letter or not self._due(ts) or not lease_until > ts:
            return "rejected"
        if self.attempt >= MAX_ATTEMPTS:
            self.status, self.error, self.dead_letter = "failed", fv.EXHAUSTED_CODE, True
            self._release()
            return "rejected"
        self.status, self.attempt, self.progress, self.error = "running", self.attempt + 1, 20, None
        self.token, self.lease_until = int(seq), lease_until
        return "accepted"


def as_row(state: TaskState) -> tuple:
    return (
        state.status, state.attempt, state.progress, state.error, state.dead_letter, state.token,
        state.lease_until, state.due,
    )


def from_row(row) -> TaskState:
    values = [v if not (isinstance(v, float) and math.isnan(v)) else None for v in row]
    return TaskState(*values)
