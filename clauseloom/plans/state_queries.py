"""Task state: set-based transitions at a reference time, delivery, and the ordered fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv
from clauseloom.operators import taskstate as ts
from clauseloom.operators import views as vw
from clauseloom.plans.catalog import entry
from clauseloom.plans.metric_queries import _NOW, now
from clauseloom.sources.derived import derive

_DUE = f"((status = 'queued' AND next_attempt_at <= {_NOW}) OR (status = 'running' AND lease_expires_at <= {_NOW}))"
_AT = f"strftime({_NOW}, '%Y-%m-%d %H:%M:%S')"
_F = "'%Y-%m-%d %H:%M:%S'"


def tasks(spark, sf_dir):
    return derive(spark, sf_dir, "parse_tasks")


@entry(
    "st_claim",
    ("parse_tasks",),
    f"""SELECT id, file_id, 'running' AS status, CAST(20 AS BIGINT) AS progress, attempt + 1 AS attempt, {_AT} AS started_at,
               strftime({_NOW} + INTERVAL '30' SECOND, {_F}) AS lease_expires_at, 'parsing' AS file_status
        FROM parse_tasks WHERE dead_lettered_at IS NULL AND attempt < 3 AND {_DUE}""",
)
def st_claim(spark, sf_dir):
    return ts.claim(tasks(spark, sf_dir), now())


@entry(
    "st_dead_letter",
    ("parse_tasks",),
    f"""SELECT id, file_id, 'failed' AS status, '{fv.EXHAUSTED_CODE}' AS error_code, attempt, {_AT} AS dead_lettered_at, 'failed' AS file_status
        FROM parse_tasks WHERE dead_lettered_at IS NULL AND attempt >= 3 AND {_DUE}""",
)
def st_dead_letter(spark, sf_dir):
    return ts.dead_letter(tasks(spark, sf_dir), now())


# What workers present: some a stale token, some another worker's name.
_PRESENTED = """
    SELECT *, CASE WHEN attempt = 1 THEN 'old-token' ELSE lease_token END AS presented_token,
           CASE WHEN attempt = 4 THEN 'worker-9' ELSE lease_owner END AS presented_owner,
           CASE ascii(substr(id, 3, 1)) % 4 WHEN 0 THEN 'OBJECT_STORAGE_UNAVAILABLE' WHEN 1 THEN 'INVALID_DOCX' WHEN 2 THEN 'DATABASE_UNAVAILABLE' ELSE 'ODD' END AS error_code
    FROM {parse_tasks}"""
_HOLDS = f"coalesce(status = 'running' AND lease_owner = presented_owner AND lease_token = presented_token AND lease_expires_at > {_NOW}, false)"


def presented(spark, sf_dir):
    return spark.sql(_PRESENTED, parse_tasks=tasks(spark, sf_dir))


_PRESENTED_SQL = _PRESENTED.format(parse_tasks="parse_tasks")


@entry(
    "st_complete",
    ("parse_tasks", "requirements"),
    f"""SELECT id, accepted, CASE WHEN accepted THEN 'succeeded' ELSE status END AS status, CASE WHEN accepted THEN 100 ELSE progress END AS progress,
               CASE WHEN accepted THEN (SELECT count(*) FROM requirements r WHERE r.tenant_id = p.tenant_id AND r.task_id = p.id) ELSE 0 END AS visible,
               CASE WHEN accepted THEN 'parsed' END AS file_status
        FROM (SELECT *, {_HOLDS} AS accepted FROM ({_PRESENTED_SQL})) p""",
)
def st_complete(spark, sf_dir):
    return ts.complete(presented(spark, sf_dir), derive(spark, sf_dir, "requirements"), now())


_RETRY = "error_code IN ('OBJECT_STORAGE_UNAVAILABLE', 'DATABASE_UNAVAILABLE') AND attempt < 3"
_REPORTED = f"""
    SELECT id, tenant_id, error_code, CASE WHEN NOT ok THEN 'stale' WHEN retry THEN 'requeued' ELSE 'failed' END AS outcome,
           CASE WHEN NOT ok THEN status WHEN retry THEN 'queued' ELSE 'failed' END AS status,
           CASE WHEN ok AND retry THEN {_NOW} + CAST(pow(2, least(greatest(attempt - 1, 0), 16)) AS INT) * INTERVAL '1' SECOND END AS due_at,
           CASE WHEN ok AND NOT retry THEN {_AT} END AS dead_lettered_at, CASE WHEN ok AND retry THEN 'queued' WHEN ok THEN 'failed' END AS file_status
    FROM (SELECT *, {_HOLDS} AS ok, {_RETRY} AS retry FROM ({_PRESENTED_SQL}))"""


@entry(
    "st_fail",
    ("parse_tasks",),
    f"SELECT id, error_code, status, dead_lettered_at, file_status FROM ({_REPORTED}) WHERE outcome = 'failed'",
)
def st_fail(spark, sf_dir):
    rows = ts.fail_or_requeue(presented(spark, sf_dir), now()).filter("outcome = 'failed'")
    return rows.select("id", "error_code", "status", "dead_lettered_at", "file_status")


@entry(
    "st_requeue",
    ("parse_tasks",),
    f"""SELECT id, error_code, outcome, status, strftime(due_at, {_F}) AS due_at, file_status,
               CASE WHEN due_at IS NOT NULL THEN substr(md5('retry:' || tenant_id || ':' || id || ':' || strftime({_NOW}, '%Y%m%d%H%M%S')), 1, 26) END AS event_id
        FROM ({_REPORTED}) WHERE outcome <> 'failed'""",
)
def st_requeue(spark, sf_dir):
    judged = ts.fail_or_requeue(presented(spark, sf_dir), now()).filter("outcome <> 'failed'")
    event = F.when(F.col("due_at").isNotNull(), ts.retry_event_id(now()))
    return judged.select("id", "error_code", "outcome", "status", "due_at", "file_status", event.alias("event_id"))


@entry(
    "st_manual_retry",
    ("parse_tasks",),
    f"""SELECT tenant_id, id, file_id, 'queued' AS status, CAST(0 AS BIGINT) AS progress, CAST(0 AS BIGINT) AS attempt, {_AT} AS next_attempt_at, 'queued' AS file_status,
               substr(md5('retry:' || tenant_id || ':' || id || ':' || strftime({_NOW}, '%Y%m%d%H%M%S')), 1, 26) AS event_id
        FROM parse_tasks WHERE status = 'failed'""",
)
def st_manual_retry(spark, sf_dir):
    return ts.manual_retry(tasks(spark, sf_dir), now()).withColumn("event_id", ts.retry_event_id(now()))


@entry(
    "st_lease_expiry",
    ("parse_tasks",),
    f"""SELECT id, lease_owner, attempt, date_diff('second', lease_expires_at, {_NOW}) // 60 AS overdue_minutes, attempt < 3 AS reclaimable
        FROM parse_tasks WHERE status = 'running' AND lease_expires_at <= {_NOW}""",
)
def st_lease_expiry(spark, sf_dir):
    lost = tasks(spark, sf_dir).filter((F.col("status") == "running") & (F.col("lease_expires_at") <= now()))
    return lost.select(
        "id", "lease_owner", "attempt",
        F.timestamp_diff("MINUTE", F.col("lease_expires_at"), now()).alias("overdue_minutes"),
        (F.col("attempt") < ts.MAX_ATTEMPTS).alias("reclaimable"),
    )


@entry(
    "st_backoff",
    ("outbox",),
    """SELECT id, CAST(1000 * pow(2, least(greatest(publish_attempts * 4 - 1, 0), 16)) AS BIGINT) AS task_delay_ms,
              CAST(least(1000 * pow(2, least(greatest(publish_attempts * 4 - 1, 0), 16)), 60000) AS BIGINT) AS publish_delay_ms FROM outbox""",
)
def st_backoff(spark, sf_dir):
    attempt = F.col("publish_attempts") * 4
    return derive(spark, sf_dir, "outbox").select(
        "id", ts.backoff_ms(attempt, ts.TASK_BACKOFF_MS).alias("task_delay_ms"),
        ts.backoff_ms(attempt, ts.TASK_BACKOFF_MS, ts.PUBLISH_CAP_MS).alias("publish_delay_ms"),
    )


@entry(
    "st_file_status_cascade",
    ("parse_tasks", "project_files"),
    """SELECT f.tenant_id, f.id, coalesce(CASE t.status WHEN 'queued' THEN 'queued' WHEN 'running' THEN 'parsing' WHEN 'succeeded' THEN 'parsed' WHEN 'failed' THEN 'failed' END, f.parse_status) AS parse_status
       FROM project_files f LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, file_id ORDER BY created_at DESC, id DESC) AS rn FROM parse_tasks) WHERE rn = 1) t
         ON t.tenant_id = f.tenant_id AND t.file_id = f.id""",
)
def st_file_status_cascade(spark, sf_dir):
    return ts.cascade(derive(spark, sf_dir, "project_files"), vw.latest_task(tasks(spark, sf_dir)))


_FREE = f"published_at IS NULL AND available_at <= {_NOW} AND (lease_owner IS NULL OR lease_expires_at <= {_NOW})"


@entry(
    "st_outbox_due",
    ("outbox",),
    f"""SELECT id, task_id, publish_attempts + 1 AS publish_attempts, strftime(available_at, {_F}) AS available_at FROM outbox
        WHERE {_FREE} ORDER BY outbox.available_at, created_at, id LIMIT 20""",
)
def st_outbox_due(spark, sf_dir):
    return ts.outbox_due(derive(spark, sf_dir, "outbox"), now(), 20).select(
        "id", "task_id", "publish_attempts", "available_at"
    )


@entry(
    "st_dedup_delivery",
    ("outbox", "parse_tasks"),
    """SELECT o.id AS event_id, o.task_id, CASE WHEN t.status IS NULL OR t.status IN ('succeeded', 'failed') THEN 'acknowledge' ELSE 'process' END AS action
       FROM (SELECT id, tenant_id, CASE WHEN publish_attempts = 5 THEN task_id || 'x' ELSE task_id END AS task_id FROM outbox) o LEFT JOIN parse_tasks t ON t.tenant_id = o.tenant_id AND t.id = o.task_id""",
)
def st_dedup_delivery(spark, sf_dir):
    outbox = derive(spark, sf_dir, "outbox")
    gone = F.when(F.col("publish_attempts") == 5, F.concat("task_id", F.lit("x"))).otherwise(F.col("task_id"))
    delivered = outbox.select(F.col("id").alias("event_id"), "tenant_id", gone.alias("task_id"), "publish_attempts")
    # At-least-once: an event arrives as often as it was published.
    copies = delivered.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), "publish_attempts")))
    return ts.deliveries(copies, tasks(spark, sf_dir))


@entry(
    "st_reclaim_idle",
    ("outbox",),
    f"""SELECT id, task_id, date_diff('second', created_at, {_NOW}) // 60 AS idle_minutes FROM outbox
        WHERE published_at IS NULL AND id > 'O4' AND date_diff('second', created_at, {_NOW}) // 60 >= 30 ORDER BY id LIMIT 50""",
)
def st_reclaim_idle(spark, sf_dir):
    pending = derive(spark, sf_dir, "outbox").filter("published_at IS NULL").withColumnRenamed("created_at", "last_seen")
    return ts.idle_deliveries(pending, now(), 30, "O4", 50)


# The fold in SQL: one recursion step per event of a task.
_CLAIMABLE = "((s.status = 'queued' AND (s.due IS NULL OR s.due <= e.ts)) OR (s.status = 'running' AND s.lease_until <= e.ts))"
_LEASED = "(s.status = 'running' AND e.token = s.token AND s.lease_until > e.ts)"
_FOLD = f"""
    WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, task_id ORDER BY ts, seq) AS n FROM task_log),
    state AS (
      SELECT tenant_id, task_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS VARCHAR) AS outcome,
             'queued' AS status, CAST(0 AS BIGINT) AS attempt, CAST(0 AS BIGINT) AS progress, CAST(NULL AS VARCHAR) AS error, false AS dead_letter,
             CAST(NULL AS BIGINT) AS token, CAST(NULL AS TIMESTAMP) AS lease_until, CAST(NULL AS TIMESTAMP) AS due
      FROM (SELECT DISTINCT tenant_id, task_id FROM task_log)
      UNION ALL
      SELECT tenant_id, task_id, n, seq, ts, event,
             CASE act WHEN 'claim' THEN 'accepted' WHEN 'exhaust' THEN 'rejected' WHEN 'no' THEN 'rejected' WHEN 'stale' THEN 'stale' ELSE 'accepted' END,
             CASE act WHEN 'claim' THEN 'running' WHEN 'exhaust' THEN 'failed' WHEN 'retry' THEN 'queued' WHEN 'complete' THEN 'succeeded' WHEN 'requeue' THEN 'queued' WHEN 'fail' THEN 'failed' ELSE status END,
             CASE act WHEN 'claim' THEN attempt + 1 WHEN 'retry' THEN 0 ELSE attempt END,
             CASE act WHEN 'claim' THEN 20 WHEN 'retry' THEN 0 WHEN 'complete' THEN 100 WHEN 'requeue' THEN 0 ELSE progress END,
             CASE act WHEN 'claim' THEN NULL WHEN 'exhaust' THEN '{fv.EXHAUSTED_CODE}' WHEN 'retry' THEN NULL WHEN 'complete' THEN NULL WHEN 'requeue' THEN error_code WHEN 'fail' THEN error_code ELSE error END,
             CASE act WHEN 'exhaust' THEN true WHEN 'fail' THEN true WHEN 'retry' THEN false ELSE dead_letter END,
             CASE WHEN act = 'claim' THEN seq WHEN act IN ('exhaust', 'retry', 'complete', 'requeue', 'fail') THEN NULL ELSE token END,
             CASE WHEN act IN ('claim', 'renew') THEN new_lease WHEN act IN ('exhaust', 'retry', 'complete', 'requeue', 'fail') THEN NULL ELSE lease_until END,
             CASE WHEN act = 'retry' THEN ts WHEN act = 'requeue' THEN ts + CAST(pow(2, least(greatest(attempt - 1, 0), 16)) AS INT) * INTERVAL '1' SECOND ELSE due END
      FROM (SELECT s.tenant_id, s.task_id, e.n, e.seq, e.ts, e.event, e.error_code, e.lease_expires_at AS new_lease, s.status, s.attempt, s.progress, s.error, s.dead_letter, s.token, s.lease_until, s.due,
              CASE WHEN e.event = 'claim' THEN CASE WHEN s.dead_letter OR NOT {_CLAIMABLE} THEN 'no' WHEN s.attempt >= 3 THEN 'exhaust' ELSE 'claim' END
                   WHEN e.event = 'retry' THEN CASE WHEN s.status = 'failed' THEN 'retry' ELSE 'no' END
                   WHEN NOT coalesce({_LEASED}, false) THEN 'stale'
                   WHEN e.event = 'renew' THEN 'renew' WHEN e.event = 'complete' THEN 'complete'
                   WHEN e.event = 'requeue' AND e.error_code IN ('OBJECT_STORAGE_UNAVAILABLE', 'DATABASE_UNAVAILABLE') AND s.attempt < 3 THEN 'requeue' ELSE 'fail' END AS act
            FROM state s JOIN numbered e ON e.tenant_id = s.tenant_id AND e.task_id = s.task_id AND e.n = s.n + 1))
    SELECT * FROM state WHERE n > 0"""


@entry(
    "st_task_fold",
    ("task_log",),
    f"""SELECT tenant_id, task_id, last.status AS status, last.attempt AS attempt, last.progress AS progress, last.error AS error, last.dead_letter AS dead_letter, strftime(last.ts, {_F}) AS updated_at, accepted, stale
        FROM (SELECT tenant_id, task_id, arg_max(struct_pack(status := status, attempt := attempt, progress := progress, error := error, dead_letter := dead_letter, ts := ts), n) AS last,
                     count(*) FILTER (WHERE outcome = 'accepted') AS accepted, count(*) FILTER (WHERE outcome = 'stale') AS stale FROM ({_FOLD}) GROUP BY tenant_id, task_id)""",
)
def st_task_fold(spark, sf_dir):
    return ts.final_states(ts.fold_events(derive(spark, sf_dir, "task_log")))


@entry(
    "st_fencing",
    ("task_log",),
    f"SELECT tenant_id, task_id, seq, event, outcome, status FROM ({_FOLD})",
)
def st_fencing(spark, sf_dir):
    return ts.fold_events(derive(spark, sf_dir, "task_log")).select(
        "tenant_id", "task_id", "seq", "event", "outcome", "status"
    )
