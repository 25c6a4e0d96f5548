import pytest
from pyspark.sql import functions as F

import __spark_entry__ as api
from clauseloom.operators import taskstate, views
from clauseloom.sources import sinks

ROWS = "tenant_id string, task_id string, id string, title string"


def test_batches_of_one_tenant_do_not_touch_each_other(spark, tmp_path):
    path = str(tmp_path / "requirements")

    def write(batch, *rows):
        sinks.write_requirements(spark.createDataFrame(list(rows), ROWS), path, batch)

    write(1, ("t", "TA", "1", "old"), ("t", "TA", "2", "old"))
    write(2, ("t", "TB", "1", "b"), ("u", "TA", "1", "other tenant"))
    write(1, ("t", "TA", "1", "old"), ("t", "TA", "2", "old"))
    write(3, ("t", "TA", "1", "new"))
    write(2, ("t", "TB", "1", "b"), ("u", "TA", "1", "other tenant"))
    found = sorted(tuple(r) for r in sinks.read_requirements(spark, path).select("tenant_id", "task_id", "id", "title").collect())
    assert found == [("t", "TA", "1", "new"), ("t", "TB", "1", "b"), ("u", "TA", "1", "other tenant")]


def test_notes_are_trimmed_and_measured_in_units(spark):
    requirements = spark.createDataFrame([("t", "p", str(i), f"c{i}") for i in range(4)], "tenant_id string, project_id string, id string, code string")
    notes = ["\t　seen ", "\U0001f600" * 501, "\U0001f600" * 500 + "\n", None]
    decisions = spark.createDataFrame(
        [("t", "p", str(i), "confirmed", n, None) for i, n in enumerate(notes)] + [("u", "p", "3", "confirmed", "x", None)],
        "tenant_id string, project_id string, id string, decision string, note string, decided_at timestamp",
    )
    got = {r.id: r.confirmation_note for r in views.confirm(requirements, decisions).collect()}
    assert got == {"0": "seen", "2": "\U0001f600" * 500, "3": None}


def test_the_same_id_under_two_tenants(spark):
    rows = spark.createDataFrame([("t", "p", "1"), ("u", "p", "1"), ("t", "q", "1")], "tenant_id string, project_id string, id string")
    assert views.scoped(rows, "t").count() == 2 and views.scoped(rows, "t", "p").count() == 1
    chosen = rows.filter("tenant_id = 't' AND project_id = 'p'")
    more = rows.withColumns({"owner": F.lit("o"), "section": F.lit("s"), "status": F.lit("x"), "confirmed": F.lit(False)}).filter("project_id = 'p'")
    assert sorted(r.confirmed for r in views.bulk_assign(more, chosen, "new", "sec").collect()) == [False, True]


def test_one_event_id_under_two_tenants(spark):
    log = spark.createDataFrame([("t", "e", "A"), ("u", "e", "B"), ("t", "e", "A")], "tenant_id string, event_id string, task_id string")
    tasks = spark.createDataFrame([("t", "A", "running"), ("u", "B", "failed")], "tenant_id string, id string, status string")
    got = sorted(tuple(r) for r in taskstate.deliveries(log, tasks).collect())
    assert got == [("e", "A", "process"), ("e", "B", "acknowledge")]


TASKS = "tenant_id string, id string, status string"


def test_a_batch_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    states = lambda *rows: spark.createDataFrame(list(rows), TASKS)
    results = lambda *rows: spark.createDataFrame(list(rows), ROWS)

    def seen(name):
        return sorted(tuple(r) for r in sinks.published(spark, path, name).collect())

    assert sinks.publish(results(("t", "A", "1", "a")), states(("t", "A", "succeeded")), path, 0)
    first = seen("requirements"), seen("tasks")

    class Broken:
        """Task states that cannot be written, as if the writer died between the two tables."""

        def __getattr__(self, name):
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        sinks.publish(results(("t", "B", "2", "b"), ("t", "A", "1", "newer")), Broken(), path, 1)
    assert (seen("requirements"), seen("tasks")) == first

    # Killed once more, before the commit alone is missing.
    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, rows, schema=None, **k: Broken() if "attempt" in str(schema) else real(rows, schema, **k))
    newer = real([("t", "B", "2", "b"), ("t", "A", "1", "newer")], ROWS), real([("t", "B", "succeeded"), ("t", "A", "failed")], TASKS)
    with pytest.raises(RuntimeError, match="killed"):
        sinks.publish(*newer, path, 1)
    monkeypatch.undo()
    assert (seen("requirements"), seen("tasks")) == first

    assert sinks.publish(*newer, path, 1) and not sinks.publish(*newer, path, 1)
    assert seen("requirements") == [("t", "A", "1", "newer"), ("t", "B", "2", "b")]
    assert seen("tasks") == [("t", "A", "failed"), ("t", "B", "succeeded")]
    # A later result without rows takes the earlier rows away.
    assert sinks.publish(results(("t", "Z", "9", "z")).limit(0), states(("t", "A", "failed")), path, 2)
    assert seen("requirements") == [("t", "B", "2", "b")]
    # A second commit of a batch by another writer is not seen.
    real([(2, "zzz", 0, 0)], "batch long, attempt string, requirements long, tasks long").write.mode("append").parquet(f"{path}/commits")
    assert seen("requirements") == [("t", "B", "2", "b")]


def test_a_stream_is_published_by_batches(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(3):
        spark.createDataFrame([("t", f"T{n}", "succeeded", f"r{n}")], "tenant_id string, id string, status string, title string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("tenant_id string, id string, status string, title string").option("maxFilesPerTrigger", 1).parquet(source)
    write = sinks.publisher(path, lambda b: b.select("tenant_id", "id", "status"), lambda b: b.selectExpr("tenant_id", "id as task_id", "title"))
    for _ in range(2):
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.title for r in sinks.published(spark, path, "requirements").collect()) == ["r0", "r1", "r2"]
    assert sinks.committed(spark, path).count() == 3


def test_batches_are_parts_of_one_written_result(spark, sf_dir, monkeypatch):
    """The join that finds what is to be written runs once, not for every batch."""
    plans, write, publish = [], sinks.write_requirements, sinks.publish

    def note(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(sinks, "write_requirements", lambda rows, *rest: (note(rows), write(rows, *rest))[1])
    monkeypatch.setattr(sinks, "publish", lambda rows, tasks, *rest: (note(rows), note(tasks), publish(rows, tasks, *rest))[2])
    for name in ("sink_requirements", "sink_published"):
        assert api.queries()[name](spark, sf_dir).count() > 0
    assert len(plans) == 12 and not any("Join" in plan for plan in plans)
