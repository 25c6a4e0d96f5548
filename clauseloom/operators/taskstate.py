"""Task life cycle as set-based transitions, and the ordered fold of a task-event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv
from clauseloom.operators.quality import failure_class
from clauseloom.streaming.transitions import OUTCOME_SCHEMA, TaskState

MAX_ATTEMPTS = 3
LEASE_SECONDS = 30
TASK_BACKOFF_MS, PUBLISH_CAP_MS = 1_000, 60_000


def due_now(now: Column) -> Column:
    """Queued and due, or running with an expired lease."""
    return ((F.col("status") == "queued") & (F.col("next_attempt_at") <= now)) | (
        (F.col("status") == "running") & (F.col("lease_expires_at") <= now)
    )


def claimable(now: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    return F.col("dead_lettered_at").isNull() & (F.col("attempt") < max_attempts) & due_now(now)


def exhausted(now: Column, max_attempts: int = MAX_ATTEMPTS) -> Column:
    return F.col("dead_lettered_at").isNull() & (F.col("attempt") >= max_attempts) & due_now(now)


def seconds(n: int | Column) -> Column:
    return F.make_dt_interval(secs=F.lit(n) if isinstance(n, int) else n)


def claim(tasks: DataFrame, now: Column) -> DataFrame:
    """The rows a claim changes: running, one attempt more, a fresh lease."""
    return tasks.filter(claimable(now)).select(
        "id", "file_id", F.lit("running").alias("status"), F.lit(20).alias("progress"),
        (F.col("attempt") + 1).alias("attempt"), now.alias("started_at"),
        (now + seconds(LEASE_SECONDS)).alias("lease_expires_at"), F.lit("parsing").alias("file_status"),
    )


def dead_letter(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.filter(exhausted(now)).select(
        "id", "file_id", F.lit("failed").alias("status"), F.lit(fv.EXHAUSTED_CODE).alias("error_code"),
        "attempt", now.alias("dead_lettered_at"), F.lit("failed").alias("file_status"),
    )


def lease_holds(now: Column) -> Column:
    """The presented owner and token are the current ones and the lease has not run out."""
    return F.coalesce(
        (F.col("status") == "running")
        & (F.col("lease_owner") == F.col("presented_owner"))
        & (F.col("lease_token") == F.col("presented_token"))
        & (F.col("lease_expires_at") > now),
        F.lit(False),
    )


def backoff_ms(attempt: Column, base: int, cap: int | None = None) -> Column:
    """Doubling delay: base · 2^(attempt-1), exponent held in 0..16, optionally capped."""
    exponent = F.least(F.greatest(attempt - 1, F.lit(0).cast("long")), F.lit(16).cast("long"))
    delay = F.lit(base).cast("long") * F.pow(F.lit(2), exponent).cast("long")
    return delay if cap is None else F.least(delay, F.lit(cap).cast("long"))


def complete(requests: DataFrame, requirements: DataFrame, now: Column) -> DataFrame:
    """Accepted completions with the number of requirements that become visible; the rest is stale."""
    counted = requirements.groupBy("tenant_id", F.col("task_id").alias("id")).agg(F.count("*").alias("visible"))
    judged = requests.withColumn("accepted", lease_holds(now)).join(counted, ["tenant_id", "id"], "left")
    ok = F.col("accepted")
    return judged.select(
        "id", "accepted", F.when(ok, "succeeded").otherwise(F.col("status")).alias("status"),
        F.when(ok, 100).otherwise(F.col("progress")).cast("long").alias("progress"),
        F.when(ok, F.coalesce("visible", F.lit(0))).otherwise(0).cast("long").alias("visible"),
        F.when(ok, "parsed").alias("file_status"),
    )


def fail_or_requeue(requests: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Outcome of a reported error: requeue while transient with attempts left, else fail.

    A permanent failure, or the last transient one, is dead-lettered.
    """
    transient = F.coalesce(failure_class(F.col("error_code")) == "transient", F.lit(False))
    retry = transient & (F.col("attempt") < max_attempts)
    ok = lease_holds(now)
    delay = backoff_ms(F.col("attempt"), TASK_BACKOFF_MS) / 1000
    return requests.select(
        "tenant_id", "id", "error_code",
        F.when(~ok, "stale").when(retry, "requeued").otherwise("failed").alias("outcome"),
        F.when(~ok, F.col("status")).when(retry, "queued").otherwise("failed").alias("status"),
        F.when(ok & retry, now + seconds(delay)).alias("due_at"),
        F.when(ok & ~retry, now).alias("dead_lettered_at"),
        F.when(ok & retry, "queued").when(ok, "failed").alias("file_status"),
    )


def retry_event_id(created_at: Column) -> Column:
    """Id of the event that announces a task again: a hash of its natural key."""
    key = F.concat_ws(":", F.lit("retry"), "tenant_id", "id", F.date_format(created_at, "yyyyMMddHHmmss"))
    return F.substring(F.md5(key), 1, 26)


def publish_events(rows: DataFrame, available_at: str, created_at: Column) -> DataFrame:
    """Outbox rows for tasks that must be announced again."""
    return rows.select(
        retry_event_id(created_at).alias("event_id"), "tenant_id", F.col("id").alias("task_id"),
        F.col(available_at).alias("available_at"), created_at.alias("created_at"),
        F.lit(0).alias("publish_attempts"),
    )


def manual_retry(tasks: DataFrame, now: Column) -> DataFrame:
    return tasks.filter("status = 'failed'").select(
        "tenant_id", "id", "file_id", F.lit("queued").alias("status"), F.lit(0).alias("progress"),
        F.lit(0).alias("attempt"), now.alias("next_attempt_at"), F.lit("queued").alias("file_status"),
    )


FILE_STATUS = {"queued": "queued", "running": "parsing", "succeeded": "parsed", "failed": "failed"}


def cascade(files: DataFrame, latest: DataFrame) -> DataFrame:
    """File status as driven by its latest task; files without a task keep theirs."""
    status = F.col("task.status")
    driven = F.coalesce(*[F.when(status == k, v) for k, v in FILE_STATUS.items()])
    joined = files.join(latest.withColumnRenamed("file_id", "id"), ["tenant_id", "id"], "left")
    return joined.select("tenant_id", "id", F.coalesce(driven, "parse_status").alias("parse_status"))


def outbox_free(now: Column) -> Column:
    return (
        F.col("published_at").isNull()
        & (F.col("available_at") <= now)
        & (F.col("lease_owner").isNull() | (F.col("lease_expires_at") <= now))
    )


def outbox_due(outbox: DataFrame, now: Column, limit: int) -> DataFrame:
    """The next batch to publish, each with one more attempt (a top-n, not a full sort)."""
    batch = outbox.filter(outbox_free(now)).orderBy("available_at", "created_at", "id").limit(limit)
    return batch.withColumn("publish_attempts", F.col("publish_attempts") + 1)


def settle(outbox: DataFrame, receipts: DataFrame, now: Column) -> DataFrame:
    """What the broker's ``receipts(tenant_id, event_id, delivered)`` make of the due events: published, or released
    with a capped backoff. An event counts as delivered once any receipt says so; without a receipt it stays as it is."""
    heard = receipts.groupBy("tenant_id", F.col("event_id").alias("id")).agg(F.bool_or("delivered").alias("delivered"))
    claimed = outbox.filter(outbox_free(now)).withColumn("publish_attempts", F.col("publish_attempts") + 1)
    failed = ~F.col("delivered")
    delay = backoff_ms(F.col("publish_attempts"), TASK_BACKOFF_MS, PUBLISH_CAP_MS)
    return claimed.join(heard, ["tenant_id", "id"]).select(
        "id", "publish_attempts", F.when(failed, "released").otherwise("published").alias("outcome"),
        F.when(~failed, now).alias("published_at"),
        F.when(failed, now + seconds(delay / 1000)).alias("available_at"),
        F.when(failed, "TASK_QUEUE_PUBLISH_FAILED").alias("error_code"),
    )


def deliveries(log: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each event once, with what the consumer does about it.

    Terminal or deleted tasks are acknowledged without effect.
    """
    once = log.dropDuplicates(["tenant_id", "event_id"])
    state = tasks.select("tenant_id", F.col("id").alias("task_id"), "status")
    known = once.join(state, ["tenant_id", "task_id"], "left")
    terminal = F.col("status").isNull() | F.col("status").isin("succeeded", "failed")
    return known.select(
        "event_id", "task_id", F.when(terminal, "acknowledge").otherwise("process").alias("action")
    )


def idle_deliveries(pending: DataFrame, now: Column, idle_minutes: int, after: str, count: int) -> DataFrame:
    """One page of deliveries idle for long enough, resuming after the cursor."""
    idle = F.timestamp_diff("MINUTE", F.col("last_seen"), now)
    page = pending.filter((F.col("id") > after) & (idle >= idle_minutes))
    return page.select("id", "task_id", idle.alias("idle_minutes")).orderBy("id").limit(count)


# --- ordered fold ---------------------------------------------------------------------------------

FOLD_COLUMNS = ("tenant_id", "task_id", "seq", "ts", "event", "token", "lease_expires_at", "error_code")


def _fold_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Events arrive sorted by (tenant, task, time); one small state is alive at a time."""
    current, state = None, None
    for batch in batches:
        verdicts, snapshots = [], []
        for row in batch.itertuples(index=False):
            key = (row.tenant_id, row.task_id)
            if key != current:
                current, state = key, TaskState()
            verdicts.append(state.apply(row.seq, row.ts, row.event, row.token, row.lease_expires_at, row.error_code))
            snapshots.append(state.snapshot())
        out = batch[["tenant_id", "task_id", "seq", "ts", "event"]].copy()
        out["outcome"] = verdicts
        for i, name in enumerate(("status", "attempt", "progress", "error", "dead_letter")):
            out[name] = [s[i] for s in snapshots]
        yield out


def fold_events(log: DataFrame) -> DataFrame:
    """Every event with its verdict (accepted | stale | rejected) and the state after it.

    Rows are hash-distributed by task and sorted inside partitions, then streamed: memory does not
    grow with the length of one task's history.
    """
    ordered = (
        log.select(*FOLD_COLUMNS)
        .repartition("tenant_id", "task_id")
        .sortWithinPartitions("tenant_id", "task_id", "ts", "seq")
    )
    return ordered.mapInPandas(_fold_sorted, OUTCOME_SCHEMA)


def final_states(outcomes: DataFrame) -> DataFrame:
    """Last state per task from the fold's rows: a partial ``max_by``."""
    state = F.struct("status", "attempt", "progress", "error", "dead_letter", F.col("ts").alias("updated_at"))
    last = outcomes.groupBy("tenant_id", "task_id").agg(
        F.max_by(state, F.struct("ts", "seq")).alias("s"),
        F.count_if(F.col("outcome") == "accepted").alias("accepted"),
        F.count_if(F.col("outcome") == "stale").alias("stale"),
    )
    return last.select("tenant_id", "task_id", "s.*", "accepted", "stale")


