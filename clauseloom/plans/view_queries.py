"""Relational reads, view models, formats, updates and maintenance jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv
from clauseloom.functions import formats as fm
from clauseloom.operators import views as vw
from clauseloom.plans.catalog import entry
from clauseloom.plans.oracle_parts import trim, u16
from clauseloom.sources.derived import derive

_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def _times(*names: str) -> str:
    return ", ".join(_TIME.format(n) for n in names)


@entry(
    "q_list_projects",
    ("projects",),
    f"SELECT tenant_id, id, name, status, {_times('created_at')} FROM projects WHERE tenant_id = 't7' ORDER BY projects.created_at DESC, id",
)
def q_list_projects(spark, sf_dir):
    rows = derive(spark, sf_dir, "projects").filter("tenant_id = 't7'")
    return vw.newest_first(rows.select("tenant_id", "id", "name", "status", "created_at"))


@entry(
    "q_find_by_id",
    ("projects", "project_files", "parse_tasks"),
    """SELECT 'project' AS entity, id, status FROM projects WHERE tenant_id = 't3' AND id = 'P3'
       UNION ALL SELECT 'project', id, status FROM projects WHERE tenant_id = 't4' AND id = 'P3'
       UNION ALL SELECT 'file', f.id, f.parse_status FROM project_files f WHERE f.tenant_id = 't19' AND f.id = (SELECT min(id) FROM project_files WHERE tenant_id = 't19')
       UNION ALL SELECT 'file', f.id, f.parse_status FROM project_files f WHERE f.tenant_id = 't18' AND f.id = (SELECT min(id) FROM project_files WHERE tenant_id = 't19')
       UNION ALL SELECT 'task', t.id, t.status FROM parse_tasks t WHERE t.tenant_id = 't19' AND t.id = (SELECT min(id) FROM parse_tasks WHERE tenant_id = 't19')""",
)
def q_find_by_id(spark, sf_dir):
    projects, files, tasks = (derive(spark, sf_dir, n) for n in ("projects", "project_files", "parse_tasks"))

    def look(df, entity, status, tenant, key):
        found = vw.scoped(df, tenant).filter(F.col("id") == key)
        return found.select(F.lit(entity).alias("entity"), "id", F.col(status).alias("status"))

    # Ids to look for: the first ones of a tenant; under another tenant the same id finds nothing.
    file_id, task_id = (vw.scoped(df, "t19").agg(F.min("id")).first()[0] for df in (files, tasks))
    return (
        look(projects, "project", "status", "t3", "P3")
        .unionByName(look(projects, "project", "status", "t4", "P3"))
        .unionByName(look(files, "file", "parse_status", "t19", file_id))
        .unionByName(look(files, "file", "parse_status", "t18", file_id))
        .unionByName(look(tasks, "task", "status", "t19", task_id))
    )


@entry(
    "q_list_files",
    ("project_files",),
    f"SELECT id, file_name, size_bytes, sha256, parse_status, {_times('created_at', 'updated_at')} FROM project_files WHERE tenant_id = 't19' AND project_id = 'P19' ORDER BY project_files.created_at DESC, id",
)
def q_list_files(spark, sf_dir):
    rows = vw.scoped(derive(spark, sf_dir, "project_files"), "t19", "P19")
    return vw.newest_first(
        rows.select("id", "file_name", "size_bytes", "sha256", "parse_status", "created_at", "updated_at")
    )


@entry(
    "q_list_tasks",
    ("parse_tasks",),
    f"SELECT id, file_id, type, status, progress, attempt, {_times('created_at', 'started_at')} FROM parse_tasks WHERE tenant_id = 't19' AND project_id = 'P19' ORDER BY parse_tasks.created_at DESC, id",
)
def q_list_tasks(spark, sf_dir):
    rows = vw.scoped(derive(spark, sf_dir, "parse_tasks"), "t19", "P19")
    return vw.newest_first(
        rows.select("id", "file_id", "type", "status", "progress", "attempt", "created_at", "started_at")
    )


_LISTED = """
    SELECT r.*, f.file_name AS source_file_name, f.sha256 AS source_file_sha256, f.media_type AS source_file_media_type, t.type AS source_task_type
    FROM requirements r JOIN project_files f ON f.tenant_id = r.tenant_id AND f.project_id = r.project_id AND f.id = r.file_id
    JOIN parse_tasks t ON t.tenant_id = r.tenant_id AND t.project_id = r.project_id AND t.file_id = r.file_id AND t.id = r.task_id"""
_LIST_COLUMNS = "id, code, title, category, priority, confirmation_status, source_file_name, source_file_sha256, source_file_media_type, source_task_type"


@entry(
    "q_list_requirements",
    ("requirements", "project_files", "parse_tasks"),
    f"SELECT {_LIST_COLUMNS} FROM ({_LISTED}) WHERE tenant_id = 't11' AND project_id = 'P61' AND confirmation_status = 'confirmed' AND priority = 'mandatory' ORDER BY code, id",
)
def q_list_requirements(spark, sf_dir):
    tables = [derive(spark, sf_dir, n) for n in ("requirements", "project_files", "parse_tasks")]
    return (
        vw.requirement_list(*tables, "t11", "P61", confirmation_status="confirmed", priority="mandatory")
        .select(*_LIST_COLUMNS.split(", "))
        .orderBy("code", "id")
    )


_DECISIONS = """
    SELECT tenant_id, project_id, CASE WHEN line = 7 THEN concat('X', id) ELSE id END AS id,
           CASE WHEN line = 1 THEN 'confirmed' WHEN line = 2 THEN 'rejected' WHEN line = 3 THEN 'pending' ELSE 'confirmed' END AS decision,
           CASE WHEN page % 7 = 3 THEN '	　seen 　' WHEN page % 7 = 4 THEN repeat('😀', 600) WHEN page % 7 = 5 THEN concat(' ', repeat('😀', 500), ' ')
                WHEN line = 4 THEN repeat('n', 1001) WHEN line = 5 THEN '' WHEN line = 6 THEN NULL ELSE ' checked ' END AS note,
           updated_at + INTERVAL '1' HOUR AS decided_at
    FROM {requirements}"""


@entry(
    "q_confirm_requirement",
    ("requirements",),
    f"""SELECT r.tenant_id, r.project_id, r.id, r.code, d.decision AS confirmation_status, CASE WHEN d.note <> '' THEN {trim('d.note')} END AS confirmation_note,
               strftime(d.decided_at, '%Y-%m-%d %H:%M:%S') AS confirmed_at, strftime(d.decided_at, '%Y-%m-%d %H:%M:%S') AS updated_at
        FROM requirements r JOIN ({_DECISIONS.format(requirements='requirements')}) d ON d.tenant_id = r.tenant_id AND d.project_id = r.project_id AND d.id = r.id
        WHERE d.decision IN ('confirmed', 'rejected') AND coalesce({u16(trim('d.note'))}, 0) <= 1000""",
)
def q_confirm_requirement(spark, sf_dir):
    requirements = derive(spark, sf_dir, "requirements")
    return vw.confirm(requirements, spark.sql(_DECISIONS, requirements=requirements))


@entry(
    "q_public_view",
    ("parse_tasks",),
    f"SELECT id, project_id, file_id, type, status, progress, attempt, error, {_times('created_at', 'started_at', 'finished_at', 'updated_at')} FROM parse_tasks",
)
def q_public_view(spark, sf_dir):
    return derive(spark, sf_dir, "parse_tasks").drop(
        "tenant_id", "next_attempt_at", "lease_owner", "lease_token", "lease_expires_at", "dead_lettered_at"
    )


_NEWEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, file_id ORDER BY created_at DESC, id DESC) AS rn
             FROM parse_tasks {where}) WHERE rn = 1"""


@entry(
    "q_latest_task_per_file",
    ("parse_tasks",),
    f"SELECT tenant_id, file_id, id AS task_id, status FROM ({_NEWEST.format(where='')})",
)
def q_latest_task_per_file(spark, sf_dir):
    return vw.latest_task(derive(spark, sf_dir, "parse_tasks")).select(
        "tenant_id", "file_id", F.col("task.id").alias("task_id"), "task.status"
    )


_WHERE_FAILED = "WHERE status = 'failed'"


@entry(
    "q_latest_failed_task",
    ("parse_tasks",),
    f"SELECT tenant_id, file_id, id AS task_id FROM ({_NEWEST.format(where=_WHERE_FAILED)})",
)
def q_latest_failed_task(spark, sf_dir):
    return vw.latest_task(derive(spark, sf_dir, "parse_tasks"), F.col("status") == "failed").select(
        "tenant_id", "file_id", F.col("task.id").alias("task_id")
    )


@entry(
    "q_active_tasks",
    ("parse_tasks",),
    "SELECT id FROM parse_tasks WHERE tenant_id = 't2' AND project_id = 'P27' AND status IN ('queued', 'running') ORDER BY id",
)
def q_active_tasks(spark, sf_dir):
    rows = vw.scoped(derive(spark, sf_dir, "parse_tasks"), "t2", "P27")
    return rows.filter(F.col("status").isin("queued", "running")).select("id").orderBy("id")


_INCOMING = """
    SELECT CASE WHEN size_bytes % 7 = 0 THEN concat(id, 'n') ELSE id END AS id, 'parsed' AS parse_status, updated_at + INTERVAL '1' DAY AS updated_at
    FROM {project_files} WHERE parse_status <> 'parsed'
    UNION ALL SELECT id, 'failed', updated_at + INTERVAL '2' DAY FROM {project_files} WHERE parse_status = 'failed'"""


@entry(
    "upd_upsert_by_id",
    ("project_files",),
    f"""SELECT id, parse_status, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, updated_at DESC) AS rn FROM (
            SELECT id, parse_status, updated_at, 0 AS v FROM project_files
            UNION ALL SELECT *, 1 FROM ({_INCOMING.format(project_files='project_files')}))) WHERE rn = 1""",
)
def upd_upsert_by_id(spark, sf_dir):
    files = derive(spark, sf_dir, "project_files")
    incoming = spark.sql(_INCOMING, project_files=files)
    return vw.newest_version(files.select("id", "parse_status", "updated_at"), incoming, "id")


def _size_sql(x: str) -> str:
    return (
        f"CASE WHEN {x} < 1024 THEN {x} || ' B' WHEN {x} < 1048576 THEN greatest(1, CAST(floor({x} / 1024 + 0.5) AS BIGINT)) || ' KB'"
        f" ELSE printf('%.1f', floor({x} / 1048576 * 10 + 0.5) / 10) || ' MB' END"
    )


_CATEGORY_SQL = (
    "CASE WHEN lower(string_split(file_name, '.')[-1]) IN ('doc', 'docx') THEN '技术附件'"
    " WHEN lower(string_split(file_name, '.')[-1]) = 'txt' THEN '文本附件'{extra} ELSE '招标正文' END"
)
_EXTRA = (
    " WHEN lower(string_split(file_name, '.')[-1]) = 'zip' THEN '文件包'"
    " WHEN lower(string_split(file_name, '.')[-1]) IN ('xls', 'xlsx') THEN '评分附件'"
)


FILE_VIEW_SQL = f"""
    SELECT f.id, f.file_name AS name, {_CATEGORY_SQL.format(extra='')} AS category, {_size_sql('f.size_bytes')} AS size,
           CASE WHEN t.status = 'failed' OR f.parse_status = 'failed' THEN 'error' WHEN t.status = 'succeeded' OR f.parse_status = 'parsed' THEN 'ready' ELSE 'parsing' END AS status,
           strftime(f.updated_at, '%m-%d %H:%M') AS updated_at, t.id AS task_id, t.status AS task_status,
           CAST(coalesce(t.progress, CASE WHEN f.parse_status = 'parsed' THEN 100 END) AS BIGINT) AS progress,
           json_extract_string(t.error, '$.message') AS error, coalesce(t.status = 'failed', false) AS can_retry
    FROM project_files f LEFT JOIN ({_NEWEST.format(where='')}) t ON t.tenant_id = f.tenant_id AND t.file_id = f.id"""


@entry("q_file_view", ("project_files", "parse_tasks"), FILE_VIEW_SQL)
def q_file_view(spark, sf_dir):
    return vw.file_view(derive(spark, sf_dir, "project_files"), derive(spark, sf_dir, "parse_tasks"))


_ANCHORED = """
    SELECT *, CASE WHEN page % 2 = 0 THEN upper(substr(md5(id), 1, 8)) END AS paragraph_id, page * 3 AS paragraph_index,
           column_no AS char_start, column_no + 12 AS char_end,
           CASE WHEN page % 5 = 0 THEN '' WHEN page % 5 = 1 THEN 'A' ELSE 'A|B' END AS sections
    FROM {requirements}"""


@entry(
    "q_requirement_view",
    ("requirements",),
    f"""SELECT id, code, CASE category WHEN 'commercial' THEN '商务要求' WHEN 'compliance' THEN '合规要求' ELSE '技术要求' END AS type,
               priority = 'mandatory' AS mandatory,
               CASE WHEN kind <> 'development-fixture' THEN CAST(floor(confidence * 100 + 0.5) AS BIGINT) END AS confidence,
               CASE confirmation_status WHEN 'confirmed' THEN '待响应' WHEN 'rejected' THEN '已驳回' ELSE '未确认' END AS status,
               confirmation_status = 'confirmed' AS confirmed, CASE WHEN kind = 'pdf' THEN page END AS page,
               CASE kind WHEN 'pdf' THEN '第 ' || page || ' 页' WHEN 'docx' THEN coalesce('段落 ' || paragraph_id, '段落索引 ' || paragraph_index)
                         WHEN 'txt' THEN '第 ' || line || ' 行' ELSE coalesce(CASE WHEN sections = '' THEN NULL ELSE string_split(sections, '|')[-1] END, '未提供原文锚点') END AS anchor_label,
               CASE kind WHEN 'pdf' THEN '区域 1：第 ' || page || ' 页'
                         WHEN 'docx' THEN '范围 1：' || coalesce('段落 ' || paragraph_id || ' · ', '') || '段落索引 ' || paragraph_index || ' · 字符 ' || char_start || '–' || char_end
                         WHEN 'txt' THEN '起点 ' || line || ':' || char_start || '|终点 ' || line || ':' || char_end || '（不含）'
                         ELSE CASE WHEN sections = '' THEN '' ELSE '章节：' || replace(sections, '|', ' / ') END END AS anchor_details
        FROM ({_ANCHORED.format(requirements='requirements')})""",
)
def q_requirement_view(spark, sf_dir):
    rows = spark.sql(_ANCHORED, requirements=derive(spark, sf_dir, "requirements"))
    paths = F.filter(F.split("sections", r"\|"), lambda s: s != "")
    return vw.requirement_view(rows.withColumn("section_path", paths))


@entry("fmt_file_size", ("project_files",), f"SELECT id, {_size_sql('size_bytes')} AS size FROM project_files")
def fmt_file_size(spark, sf_dir):
    return derive(spark, sf_dir, "project_files").select("id", fm.file_size(F.col("size_bytes")).alias("size"))


@entry(
    "fmt_file_category",
    ("project_files",),
    f"SELECT id, {_CATEGORY_SQL.format(extra='')} AS listed, {_CATEGORY_SQL.format(extra=_EXTRA)} AS uploaded FROM project_files",
)
def fmt_file_category(spark, sf_dir):
    name = F.col("file_name")
    return derive(spark, sf_dir, "project_files").select(
        "id", fm.file_category(name).alias("listed"), fm.file_category(name, packages=True).alias("uploaded")
    )


@entry(
    "fmt_bands",
    ("projects",),
    """SELECT id, CASE WHEN risks >= 10 THEN 'red' WHEN risks >= 5 THEN 'amber' WHEN risks IS NOT NULL THEN 'green' END AS risk_band,
              CASE WHEN coverage < 80 THEN 'amber' WHEN coverage IS NOT NULL THEN 'green' END AS coverage_band,
              CASE WHEN coverage < 85 THEN 'confidence-low' WHEN coverage < 93 THEN 'confidence-medium' WHEN coverage IS NOT NULL THEN 'confidence-high' END AS confidence_band
       FROM projects""",
)
def fmt_bands(spark, sf_dir):
    return derive(spark, sf_dir, "projects").select(
        "id", fm.risk_band(F.col("risks")).alias("risk_band"),
        fm.coverage_band(F.col("coverage")).alias("coverage_band"),
        fm.confidence_band(F.col("coverage")).alias("confidence_band"),
    )


_STAMPS = """SELECT id, CASE WHEN size_bytes % 9 = 4 THEN concat('soon ', id) WHEN size_bytes % 9 = 5 THEN NULL
                             ELSE substr(CAST(updated_at AS STRING), 1, 19) END AS stamp FROM {project_files}"""


@entry(
    "fmt_datetime",
    ("project_files",),
    f"SELECT id, stamp, coalesce(strftime(try_cast(stamp AS TIMESTAMP), '%m-%d %H:%M'), stamp) AS shown FROM ({_STAMPS.format(project_files='project_files')})",
)
def fmt_datetime(spark, sf_dir):
    rows = spark.sql(_STAMPS, project_files=derive(spark, sf_dir, "project_files"))
    return rows.withColumn("shown", fm.short_time(F.col("stamp")))


@entry(
    "upd_bulk_assign",
    ("requirements",),
    """SELECT id, CASE WHEN hit THEN 'owner-9' ELSE owner END AS owner, CASE WHEN hit THEN '2.1 Topic 6' ELSE section END AS section,
              CASE WHEN hit THEN '编写中' ELSE status END AS status, hit OR confirmation_status = 'confirmed' AS confirmed
       FROM (SELECT *, risk = '高' AS hit FROM requirements)""",
)
def upd_bulk_assign(spark, sf_dir):
    requirements = derive(spark, sf_dir, "requirements").withColumn(
        "confirmed", F.col("confirmation_status") == "confirmed"
    )
    return vw.bulk_assign(requirements, requirements.filter("risk = '高'"), "owner-9", "2.1 Topic 6")


@entry(
    "upd_confirm_high_confidence",
    ("requirements",),
    """SELECT id, confirmation_status = 'confirmed' OR coalesce(floor(confidence * 100 + 0.5) >= 85, false) AS confirmed,
              CASE WHEN confirmation_status <> 'confirmed' AND floor(confidence * 100 + 0.5) >= 85 AND status = '未确认' THEN '待响应' ELSE status END AS status
       FROM requirements""",
)
def upd_confirm_high_confidence(spark, sf_dir):
    rows = derive(spark, sf_dir, "requirements")
    confirmed = F.col("confirmation_status") == "confirmed"
    sure = ~confirmed & F.coalesce(fm.percent(F.col("confidence")) >= fv.LOW_CONFIDENCE, F.lit(False))
    status = F.col("status")
    return rows.select(
        "id", (confirmed | sure).alias("confirmed"),
        F.when(sure, vw.confirmed_status(status, F.lit(True))).otherwise(status).alias("status"),
    )


@entry(
    "upd_confirmation_status",
    ("requirements",),
    """SELECT id, page % 2 = 0 AS confirmed, CASE WHEN page % 2 = 0 THEN CASE WHEN status = '未确认' THEN '待响应' ELSE status END ELSE '未确认' END AS status
       FROM requirements""",
)
def upd_confirmation_status(spark, sf_dir):
    decision = F.col("page") % 2 == 0
    return derive(spark, sf_dir, "requirements").select(
        "id", decision.alias("confirmed"), vw.confirmed_status(F.col("status"), decision).alias("status")
    )


@entry(
    "upd_issue_state",
    ("issues",),
    "SELECT id, CASE WHEN id % 5 = 0 THEN '已解决' WHEN id % 5 = 1 THEN '待处理' ELSE status END AS status FROM issues",
)
def upd_issue_state(spark, sf_dir):
    action = F.when(F.col("id") % 5 == 0, "close").when(F.col("id") % 5 == 1, "reopen")
    return derive(spark, sf_dir, "issues").select(
        "id",
        F.when(action == "close", fv.CLOSED_ISSUE).when(action == "reopen", fv.OPEN_ISSUE)
        .otherwise(F.col("status")).alias("status"),
    )


@entry(
    "mig_requeue_running",
    ("parse_tasks", "project_files"),
    """SELECT 'task' AS entity, id, CASE WHEN status = 'running' THEN 'queued' ELSE status END AS status FROM parse_tasks
       UNION ALL SELECT 'file', f.id, CASE WHEN f.parse_status = 'parsing' AND EXISTS (SELECT 1 FROM parse_tasks t WHERE t.tenant_id = f.tenant_id
              AND t.project_id = f.project_id AND t.file_id = f.id AND t.status IN ('queued', 'running')) THEN 'queued' ELSE f.parse_status END FROM project_files f""",
)
def mig_requeue_running(spark, sf_dir):
    tasks, files = derive(spark, sf_dir, "parse_tasks"), derive(spark, sf_dir, "project_files")
    moved = tasks.withColumn(
        "status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status"))
    )
    waiting = (
        moved.filter("status = 'queued'")
        .select("tenant_id", "project_id", F.col("file_id").alias("id"))
        .distinct()
        .withColumn("waiting", F.lit(True))
    )
    reset = (F.col("parse_status") == "parsing") & F.col("waiting").isNotNull()
    file_rows = files.join(waiting, ["tenant_id", "project_id", "id"], "left").select(
        F.lit("file").alias("entity"), "id",
        F.when(reset, "queued").otherwise(F.col("parse_status")).alias("status"),
    )
    return moved.select(F.lit("task").alias("entity"), "id", "status").unionByName(file_rows)


@entry(
    "mig_outbox_backfill",
    ("parse_tasks",),
    f"""SELECT substr(md5('phase-c:' || tenant_id || ':' || id), 1, 26) AS id, tenant_id, id AS task_id, CAST(0 AS BIGINT) AS publish_attempts,
               strftime(next_attempt_at, '%Y-%m-%d %H:%M:%S') AS available_at, {_times('created_at')} FROM parse_tasks WHERE status = 'queued'""",
)
def mig_outbox_backfill(spark, sf_dir):
    waiting = derive(spark, sf_dir, "parse_tasks").filter("status = 'queued'")
    key = F.concat_ws(":", F.lit("phase-c"), "tenant_id", "id")
    return waiting.select(
        F.substring(F.md5(key), 1, 26).alias("id"), "tenant_id", F.col("id").alias("task_id"),
        F.lit(0).cast("long").alias("publish_attempts"), F.col("next_attempt_at").alias("available_at"),
        "created_at",
    )
