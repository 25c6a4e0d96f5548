"""Sources and sinks over the provided and derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.operators import quality as dq
from clauseloom.plans.catalog import entry
from clauseloom.session import materialize, scratch_path
from clauseloom.sources import files as fs
from clauseloom.sources import notifications as nf
from clauseloom.sources import sinks
from clauseloom.sources.derived import derive, table


def stored(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.select("doc_id", F.col("text").cast("binary").alias("content"))


@entry("src_file_inventory", (), "SELECT doc_id, strlen(text) AS size_bytes, sha256(text) AS sha256 FROM documents")
def src_file_inventory(spark, sf_dir):
    return fs.inventory(stored(spark, sf_dir), "doc_id")


@entry(
    "src_text_utf8",
    (),
    """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN text END AS text,
              CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'INVALID_TEXT_ENCODING' END AS reject_reason FROM documents""",
)
def src_text_utf8(spark, sf_dir):
    # Marks and a malformed byte planted by document number.
    n = F.col("doc_id")
    head = F.when(n % 7 == 0, F.unhex(F.lit("FFFE"))).when(n % 5 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    tail = F.when(n % 11 == 0, F.unhex(F.lit("61C328"))).otherwise(F.unhex(F.lit("")))
    planted = stored(spark, sf_dir).withColumn("content", F.concat(head, "content", tail))
    return fs.decode_utf8(planted, "doc_id")


@entry(
    "src_tables",
    ("parse_tasks", "requirements", "projects", "project_files"),
    """SELECT 'project' AS entity, id, status AS code, name AS detail FROM projects
       UNION ALL SELECT 'file', id, media_type, sha256 FROM project_files
       UNION ALL SELECT 'task' AS entity, id, json_extract_string(error, '$.code') AS code, json_extract_string(error, '$.message') AS detail FROM parse_tasks
       UNION ALL SELECT 'requirement', id, json_extract_string(locator_json, '$.kind'), json_extract_string(locator_json, '$.version') FROM requirements""",
)
def src_tables(spark, sf_dir):
    error = F.from_json("error", dq.ERROR_SCHEMA)
    locator = F.from_json("locator_json", "kind string, version string")
    tasks = derive(spark, sf_dir, "parse_tasks").select(
        F.lit("task").alias("entity"), "id", error["code"].alias("code"), error["message"].alias("detail")
    )
    requirements = derive(spark, sf_dir, "requirements").select(
        F.lit("requirement").alias("entity"), "id", locator["kind"].alias("code"), locator["version"].alias("detail")
    )
    projects = derive(spark, sf_dir, "projects").select(
        F.lit("project").alias("entity"), "id", F.col("status").alias("code"), F.col("name").alias("detail")
    )
    files = derive(spark, sf_dir, "project_files").select(
        F.lit("file").alias("entity"), "id", F.col("media_type").alias("code"), F.col("sha256").alias("detail")
    )
    return projects.unionByName(files).unionByName(tasks).unionByName(requirements)


_PAYLOADS = """
    SELECT seq, CASE seq % 10 WHEN 3 THEN 'not json' WHEN 4 THEN concat('{{"eventId":"', CAST(seq AS STRING), '","tenantId":"","taskId":"', task_id, '"}}')
                WHEN 5 THEN concat('{{"eventId":"', CAST(seq AS STRING), '","taskId":"', task_id, '"}}')
                ELSE concat('{{"eventId":"', CAST(seq AS STRING), '","tenantId":"', tenant_id, '","taskId":"', task_id, '"}}') END AS payload
    FROM {task_events}"""


@entry(
    "src_task_events",
    ("task_events",),
    "SELECT seq, CAST(seq AS VARCHAR) AS event_id, tenant_id, task_id FROM task_events WHERE seq % 10 NOT IN (3, 4, 5)",
)
def src_task_events(spark, sf_dir):
    raw = spark.sql(_PAYLOADS, task_events=derive(spark, sf_dir, "task_events"))
    return nf.parse(raw).filter("NOT malformed").select("seq", "event_id", "tenant_id", "task_id")


@entry(
    "sink_requirements",
    ("requirements", "parse_tasks"),
    """SELECT r.tenant_id, r.task_id, r.id, r.code, r.title FROM requirements r
       WHERE EXISTS (SELECT 1 FROM parse_tasks t WHERE t.tenant_id = r.tenant_id AND t.id = r.task_id AND t.status = 'succeeded')""",
)
def sink_requirements(spark, sf_dir):
    rows = sinks.finished_requirements(derive(spark, sf_dir, "requirements"), derive(spark, sf_dir, "parse_tasks"))
    # The batches are parts of one result, which is joined once and not for every write.
    rows = materialize(rows.select("tenant_id", "task_id", "id", "code", "title"), "sink-rows")
    path = scratch_path(spark, "requirements")
    # Tasks of one tenant arrive in two batches, the first is replayed, and some tasks are written again later.
    part = F.pmod(F.xxhash64("tenant_id", "task_id"), F.lit(3))
    for batch, own in ((1, part == 0), (2, part != 0), (1, part == 0), (3, part == 1)):
        sinks.write_requirements(rows.filter(own), path, batch)
    return sinks.read_requirements(spark, path).select(*rows.columns)


@entry(
    "sink_published",
    ("requirements", "parse_tasks"),
    """SELECT t.tenant_id, t.id AS task_id, t.status, r.id, r.code, r.title FROM parse_tasks t
       LEFT JOIN requirements r ON r.tenant_id = t.tenant_id AND r.task_id = t.id WHERE t.status IN ('succeeded', 'failed') AND t.id < 'Tc'""",
)
def sink_published(spark, sf_dir):
    """Finished tasks and their results in three batches: the first is replayed, and of a fourth only the results get written."""
    path = scratch_path(spark, "published")
    tasks = derive(spark, sf_dir, "parse_tasks").filter("status IN ('succeeded', 'failed')").select("tenant_id", "id", "status")
    requirements = derive(spark, sf_dir, "requirements").select("tenant_id", "task_id", "id", "code", "title")
    tasks, requirements = materialize(tasks, "sink-tasks"), materialize(requirements, "sink-rows")
    bounds = [("", "T4"), ("T4", "T8"), ("T8", "Tc"), ("", "T4")]
    for batch, (low, high) in zip((1, 2, 3, 1), bounds, strict=True):
        sinks.publish(requirements.filter((F.col("task_id") >= low) & (F.col("task_id") < high)), tasks.filter((F.col("id") >= low) & (F.col("id") < high)), path, batch)
    requirements.filter("task_id >= 'Tc'").write.parquet(f"{path}/requirements/batch=4/attempt=lost")
    states = sinks.published(spark, path, "tasks").withColumnRenamed("id", "task_id")
    return states.join(sinks.published(spark, path, "requirements"), ["tenant_id", "task_id"], "left").select("tenant_id", "task_id", "status", "id", "code", "title")


@entry(
    "sink_object_layout",
    ("project_files",),
    """SELECT id, p || 'v1/original' AS original_key, coalesce(starts_with(object_key, p) AND regexp_matches(substr(object_key, length(p) + 1), '^v[1-9][0-9]*/original$'), false) AS in_boundary
       FROM (SELECT *, 'tenants/' || tenant_id || '/projects/' || project_id || '/files/' || id || '/' AS p FROM project_files)""",
)
def sink_object_layout(spark, sf_dir):
    return derive(spark, sf_dir, "project_files").select(
        "id", fs.original_key().alias("original_key"), fs.key_in_boundary(F.col("object_key")).alias("in_boundary")
    )


def _hashed(kind: str) -> str:
    return f"upper(substr(md5('{kind}:' || tenant_id || ':' || upload_id), 1, 26))"


@entry(
    "sink_upload_triplet",
    ("uploads",),
    f"""SELECT 'file' AS entity, {_hashed('file')} AS id, tenant_id, CAST(NULL AS VARCHAR) AS parent, 'queued' AS status FROM uploads WHERE parse_status = 'queued' AND attempt = 0
        UNION ALL SELECT 'task', {_hashed('task')}, tenant_id, {_hashed('file')}, 'queued' FROM uploads WHERE parse_status = 'queued' AND attempt = 0
        UNION ALL SELECT 'outbox', {_hashed('event')}, tenant_id, {_hashed('task')}, NULL FROM uploads WHERE parse_status = 'queued' AND attempt = 0
        UNION ALL SELECT 'reject', CAST(upload_id AS VARCHAR), tenant_id, NULL, parse_status FROM uploads WHERE NOT (parse_status = 'queued' AND attempt = 0)""",
)
def sink_upload_triplet(spark, sf_dir):
    uploads = derive(spark, sf_dir, "uploads").withColumn("name", dq.upload_name(F.col("raw_name")))
    files, tasks, outbox, rejects = fs.upload_rows(uploads)
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, entity: str, key: str, parent, status) -> DataFrame:
        return df.select(
            F.lit(entity).alias("entity"), F.col(key).cast("string").alias("id"), "tenant_id",
            parent.alias("parent"), status.alias("status"),
        )

    return reduce(
        DataFrame.unionByName,
        (
            rows(files, "file", "id", none, F.col("parse_status")),
            rows(tasks, "task", "id", F.col("file_id"), F.col("status")),
            rows(outbox, "outbox", "id", F.col("task_id"), none),
            rows(rejects, "reject", "upload_id", none, F.col("parse_status")),
        ),
    )
