"""The streaming fold against the batch fold, replay and duplicates included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import taskstate as ts
from clauseloom.sources.derived import derive
from clauseloom.streaming import delivery, taskfold
from clauseloom.streaming.transitions import TaskState

COLUMNS = ["tenant_id", "task_id", "seq", "event", "outcome", "status", "attempt"]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _later(days):
    """An event of another task, far enough ahead to carry the watermark past all others."""
    return ("t", "SENTINEL", 1, dt.datetime(2030, 1, 1) + dt.timedelta(days=days), "complete", 1, None, None)


def _run(spark, schema, source, out, checkpoint, **settings):
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    taskfold.write_outcomes(taskfold.fold_stream(events, **settings), out, checkpoint).awaitTermination(300)
    return spark.read.parquet(out)


def test_shuffled_files_fold_as_in_a_batch(spark, sf_dir, tmp_path):
    log = derive(spark, sf_dir, "task_log").select(*ts.FOLD_COLUMNS).filter("task_id IN ('T1', 'T2', 'T3', 'T4')")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = [tuple(r) for r in log.orderBy(F.xxhash64("seq")).collect()]
    for part in range(3):
        _write(spark, rows[part::3], log.schema, source)
    _write(spark, [_later(0)], log.schema, source)
    _run(spark, log.schema, source, out, checkpoint, delay="1000 days")
    # A restart finds nothing new and repeats nothing.
    streamed = _run(spark, log.schema, source, out, checkpoint, delay="1000 days").select(*COLUMNS)
    expected = ts.fold_events(log).select(*COLUMNS)
    assert sorted(streamed.collect()) == sorted(expected.collect())


def test_late_events_come_out_as_rejects(spark, sf_dir, tmp_path):
    log = derive(spark, sf_dir, "task_log").select(*ts.FOLD_COLUMNS).filter("task_id IN ('T1', 'T2', 'T3')")
    source, out, checkpoint, late = (str(tmp_path / n) for n in ("in", "out", "cp", "late"))
    rows = [tuple(r) for r in log.orderBy("ts", "seq").collect()]
    behind, ahead = rows[: len(rows) // 4], rows[len(rows) // 4 :]
    for part in (ahead, behind[::2], behind[1::2]):
        _write(spark, part, log.schema, source)
    _write(spark, [_later(0)], log.schema, source)
    events = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    taskfold.write_outcomes(taskfold.fold_stream(events, delay="1 minute"), out, checkpoint, late).awaitTermination(300)
    verdicts = sorted((r.task_id, r.seq) for r in spark.read.parquet(out).collect() if r.task_id != "SENTINEL")
    rejects = sorted((r.task_id, r.seq) for r in spark.read.parquet(late).collect())
    # Every input row comes out once, and the rest folds as if the late ones had never been.
    assert sorted(verdicts + rejects) == sorted((r[1], r[2]) for r in rows)
    # The first file set the watermark just behind its newest event.
    assert set(rejects) >= {(r[1], r[2]) for r in behind} - {(r[1], r[2]) for r in ahead} and len(rejects) == len(behind)
    expected = ts.fold_events(spark.createDataFrame(ahead, log.schema)).select(*COLUMNS)
    got = spark.read.parquet(out).filter("task_id <> 'SENTINEL'").select(*COLUMNS)
    assert sorted(got.collect()) == sorted(expected.collect())


def test_an_expired_lease_is_reported_once_and_a_renewed_one_is_not(spark, tmp_path):
    schema = "tenant_id string, task_id string, seq long, ts timestamp_ntz, event string, token long, lease_expires_at timestamp_ntz, error_code string"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = [
        ("t", "A", 1, at(0), "claim", 1, at(30), None), ("t", "B", 2, at(0), "claim", 2, at(30), None),
        ("t", "B", 3, at(20), "renew", 2, at(60), None), ("t", "B", 4, at(50), "complete", 2, None, None),
    ]
    _write(spark, rows[::-1], schema, source)
    for days in range(3):
        _write(spark, [_later(days)], schema, source)
    found = _run(spark, schema, source, out, checkpoint, delay="1 minute", leases=True).filter("task_id <> 'SENTINEL'").collect()
    assert sorted((r.task_id, r.outcome) for r in found) == [("A", "accepted"), ("A", "lease_expired"), ("B", "accepted"), ("B", "accepted"), ("B", "accepted")]
    assert [r.ts for r in found if r.outcome == "lease_expired"] == [at(30)]


def test_a_finished_task_is_forgotten_after_its_retention(spark, tmp_path):
    schema = "tenant_id string, task_id string, seq long, ts timestamp_ntz, event string, token long, lease_expires_at timestamp_ntz, error_code string"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    _write(spark, [("t", "A", 1, at(0), "claim", 1, at(30), None), ("t", "A", 2, at(5), "complete", 1, None, None)], schema, source)
    _write(spark, [_later(0)], schema, source)
    _write(spark, [_later(1)], schema, source)
    again = dt.datetime(2030, 1, 3)
    _write(spark, [("t", "A", 3, again, "claim", 3, again + dt.timedelta(seconds=30), None)], schema, source)
    _write(spark, [_later(9)], schema, source)
    found = _run(spark, schema, source, out, checkpoint, delay="1 minute", retention_hours=1).filter("task_id = 'A'").collect()
    # Without its old state the task can be claimed afresh.
    assert sorted((r.seq, r.outcome, r.attempt) for r in found) == [(1, "accepted", 1), (2, "accepted", 1), (3, "accepted", 1)]


def test_duplicate_notifications_are_dropped(spark, tmp_path):
    rows = [(f"e{i % 4}", "t", dt.datetime(2026, 7, 10, 12, i % 5)) for i in range(12)]
    spark.createDataFrame(rows, "event_id string, tenant_id string, ts timestamp").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("event_id string, tenant_id string, ts timestamp").parquet(str(tmp_path / "in"))
    query = (
        delivery.deduplicated(events).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["e0", "e1", "e2", "e3"]


def test_windows_and_rejects(spark, tmp_path):
    good = '{"eventId":"1","tenantId":"t","taskId":"T"}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(good + "\nbroken\n" + '{"eventId":"2","tenantId":"","taskId":"T"}\n')
    from clauseloom.sources import notifications

    accepted, rejected = delivery.split_notifications(notifications.stream(spark, str(tmp_path / "in")))
    for name, df in (("ok", accepted), ("bad", rejected)):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option(
            "checkpointLocation", str(tmp_path / f"cp-{name}")
        ).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_outcome_windows_count_by_hour(spark, tmp_path):
    rows = [(f"2026-07-10 0{h}:{m:02d}:00", "t", "claim") for h, m in ((1, 5), (1, 50), (2, 1), (5, 0))]
    log = spark.createDataFrame(rows, "at string, tenant_id string, event string").selectExpr("cast(at as timestamp) as ts", "tenant_id", "event")
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    delivery.outcome_windows(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.window_start.hour, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 2), (2, 1)}


def test_receipts_settle_due_events(spark):
    now = F.lit("2026-07-10 00:00:00").cast("timestamp_ntz")
    rows = [("t", str(i), i, None, None) for i in range(4)] + [("u", "0", 0, None, None)]
    outbox = spark.createDataFrame(rows, "tenant_id string, id string, publish_attempts int, lease_owner string, published_at timestamp_ntz").withColumns(
        {"available_at": now, "lease_expires_at": F.lit(None).cast("timestamp_ntz")}
    )
    receipts = spark.createDataFrame(
        [("t", "0", True), ("t", "1", False), ("t", "1", True), ("t", "2", False), ("u", "9", True)], "tenant_id string, event_id string, delivered boolean"
    )
    assert {(r.id, r.outcome) for r in ts.settle(outbox, receipts, now).collect()} == {("0", "published"), ("1", "published"), ("2", "released")}


def at(second):
    return dt.datetime(2026, 7, 10) + dt.timedelta(seconds=second)


def test_fencing_and_renewal():
    task = TaskState()
    assert task.apply(1, at(1), "claim", 1, at(11), None) == "accepted" and task.attempt == 1
    assert task.apply(2, at(5), "claim", 2, at(15), None) == "rejected"
    assert task.apply(3, at(6), "complete", 99, None, None) == "stale"
    assert task.apply(4, at(6), "renew", 1, at(20), None) == "accepted"
    assert task.apply(5, at(15), "complete", 1, None, None) == "accepted"
    assert task.snapshot() == ("succeeded", 1, 100, None, False)


def test_expired_lease_is_reclaimed_and_old_worker_is_stale():
    task = TaskState()
    task.apply(1, at(1), "claim", 1, at(5), None)
    assert task.apply(2, at(6), "complete", 1, None, None) == "stale"
    assert task.apply(3, at(6), "claim", 3, at(16), None) == "accepted" and task.attempt == 2
    assert task.apply(4, at(7), "fail", 1, None, "STALE") == "stale"
    assert task.apply(5, at(8), "requeue", 3, None, "OBJECT_STORAGE_UNAVAILABLE") == "accepted"
    assert (task.status, task.due) == ("queued", at(10))
    assert task.apply(6, at(9), "claim", 6, at(40), None) == "rejected"
    assert task.apply(7, at(10), "claim", 7, at(40), None) == "accepted"


def test_exhaustion_dead_letters_the_fourth_claim_and_retry_resets():
    task = TaskState()
    for n, second in enumerate((1, 3, 5)):
        assert task.apply(n, at(second), "claim", n, at(second + 1), None) == "accepted"
    assert task.apply(9, at(7), "claim", 9, at(8), None) == "rejected"
    assert task.snapshot() == ("failed", 3, 20, "TASK_ATTEMPTS_EXHAUSTED", True)
    assert task.apply(10, at(8), "retry", None, None, None) == "accepted"
    assert task.snapshot() == ("queued", 0, 0, None, False)


def test_idle_deliveries_are_reported_in_turn(spark, tmp_path):
    """A crowd of deliveries that are idle again and again does not keep a single later one from its turn."""
    schema = "tenant_id string, event_id string, action string, ts timestamp_ntz"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    crowd = [("t", f"c{i}", "deliver", at(0)) for i in range(40)]
    rows = [
        crowd + [("t", "acked", "deliver", at(1)), ("t", "again", "deliver", at(1)), ("u", "c1", "deliver", at(2))],
        [("t", "acked", "ack", at(20)), ("t", "again", "deliver", at(30)), ("t", "late", "deliver", at(40))], [("x", "far", "ack", at(75))], [("x", "far", "ack", at(150))], [("x", "far", "ack", at(4000))],
    ]
    for part in rows:
        _write(spark, part, schema, source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = delivery.idle_deliveries(stream, idle=60_000, delay="1 second", reports=2, shards=3)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(300)
    got = sorted((r.tenant_id, r.event_id, r.idle_since, r.reclaim_no) for r in spark.read.parquet(out).collect())
    seen = [("t", f"c{i}", 0) for i in range(40)] + [("u", "c1", 2), ("t", "again", 30), ("t", "late", 40)]
    assert got == sorted((tenant, event, at(second + 60 * n), n + 1) for tenant, event, second in seen for n in range(2))
