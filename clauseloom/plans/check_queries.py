"""Corpus checks over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.operators import checks as ck
from clauseloom.operators import fields
from clauseloom.plans.catalog import entry, with_ctes
from clauseloom.sources.derived import derive, table


@entry(
    "chk_duplicate_files",
    ("project_files",),
    "SELECT tenant_id, sha256, count(*) AS copies, min(id) AS first_id FROM project_files GROUP BY tenant_id, sha256 HAVING count(*) > 1",
)
def chk_duplicate_files(spark, sf_dir):
    return ck.duplicate_files(derive(spark, sf_dir, "project_files"))


_CONTENT = """
    SELECT id, project_id, concat(title, CASE status WHEN '编写中' THEN ' 【待补充】 text 【待补充：名称】' WHEN '未开始' THEN '【示例】待定' ELSE ' done' END) AS content
    FROM {outline}"""


@entry(
    "chk_placeholders",
    ("outline",),
    f"""SELECT * FROM (SELECT id, project_id, CAST(len(regexp_extract_all(content, '{ck.PLACEHOLDER}')) AS BIGINT) AS placeholders
        FROM ({_CONTENT.format(outline='outline')})) WHERE placeholders > 0""",
)
def chk_placeholders(spark, sf_dir):
    return ck.placeholders(spark.sql(_CONTENT, outline=derive(spark, sf_dir, "outline")))


# What the notices' own columns say, without reading their texts.
_SAID = """
    SELECT tenant_id, project_id, doc_id, 'project_name' AS field, 2 AS line_no, 'works ' || substr(project_id, 2) || ' new site' AS value FROM notices
    UNION ALL SELECT tenant_id, project_id, doc_id, 'bid_deadline', 4, '2026-' || lpad(CAST(CAST(substr(project_id, 2) AS BIGINT) % 9 + 1 AS VARCHAR), 2, '0') || '-' || day FROM notices
    UNION ALL SELECT tenant_id, project_id, doc_id, 'budget', 5, 'CNY ' || amount || '0000' FROM notices
    UNION ALL SELECT tenant_id, project_id, doc_id, 'duration', 6, CASE WHEN odd <> 3 THEN days || ' d' END FROM notices"""
_VOTED = f"""said AS ({_SAID}), votes AS (SELECT tenant_id, project_id, field, value, count(DISTINCT doc_id) AS documents FROM said WHERE value IS NOT NULL GROUP BY ALL),
    agreed AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY tenant_id, project_id, field) AS versions,
                                     row_number() OVER (PARTITION BY tenant_id, project_id, field ORDER BY documents DESC, value) AS n FROM votes) WHERE n = 1)"""


def _notice_fields(spark, sf_dir):
    return fields.document_fields(derive(spark, sf_dir, "notices").select("tenant_id", "project_id", "doc_id", "text"))


def _with_parts(names: tuple[str, ...], ctes: str, body: str) -> str:
    return with_ctes(names, "").rstrip() + f",\n{ctes}\n{body}"


@entry("chk_field_values", sql=_with_parts(("notices",), f"said AS ({_SAID})", "SELECT tenant_id, project_id, doc_id, field, CAST(line_no AS BIGINT) AS line_no, value FROM said"))
def chk_field_values(spark, sf_dir):
    return _notice_fields(spark, sf_dir).drop("raw")


@entry("chk_field_consistency", sql=_with_parts(
    ("notices",), _VOTED,
    """SELECT s.tenant_id, s.project_id, s.field, s.doc_id, CAST(s.line_no AS BIGINT) AS line_no, s.value, a.value AS agreed, a.documents
       FROM said s LEFT JOIN agreed a ON a.tenant_id = s.tenant_id AND a.project_id = s.project_id AND a.field = s.field WHERE s.value IS NULL OR s.value <> a.value""",
))
def chk_field_consistency(spark, sf_dir):
    return fields.field_conflicts(_notice_fields(spark, sf_dir), "tenant_id", "project_id").drop("raw")


@entry("chk_field_consensus", sql=_with_parts(("notices",), _VOTED, "SELECT tenant_id, project_id, field, value, documents, versions FROM agreed"))
def chk_field_consensus(spark, sf_dir):
    return fields.field_consensus(_notice_fields(spark, sf_dir), "tenant_id", "project_id")


@entry(
    "chk_file_attributes",
    ("project_files",),
    """SELECT tenant_id, project_id, field, low, high FROM (
         SELECT tenant_id, project_id, 'parse_status' AS field, min(parse_status) AS low, max(parse_status) AS high FROM project_files GROUP BY ALL
         UNION ALL SELECT tenant_id, project_id, 'media_type', min(media_type), max(media_type) FROM project_files GROUP BY ALL) WHERE low <> high""",
)
def chk_file_attributes(spark, sf_dir):
    return ck.inconsistent_fields(derive(spark, sf_dir, "project_files"), ("tenant_id", "project_id"), ("parse_status", "media_type"))


_INVENTORY = """
    SELECT CASE WHEN size_bytes % 12 = 3 THEN concat(object_key, '.lost') ELSE object_key END AS object_key,
           CASE WHEN size_bytes % 12 = 4 THEN 'other' ELSE object_etag END AS etag FROM {project_files} WHERE object_key IS NOT NULL"""


@entry(
    "chk_orphan_objects",
    ("project_files",),
    f"""SELECT * FROM (SELECT coalesce(i.object_key, f.object_key) AS object_key, f.id, CASE WHEN f.id IS NULL THEN 'orphan_object' WHEN i.etag IS NULL THEN 'missing_object'
               WHEN i.etag <> f.object_etag THEN 'etag_mismatch' ELSE 'ok' END AS status
        FROM ({_INVENTORY.format(project_files='project_files')}) i FULL JOIN (SELECT * FROM project_files WHERE object_key IS NOT NULL) f ON f.object_key = i.object_key) WHERE status <> 'ok'""",
)
def chk_orphan_objects(spark, sf_dir):
    files = derive(spark, sf_dir, "project_files")
    return ck.object_reconciliation(spark.sql(_INVENTORY, project_files=files), files)


_AUDIT = """
    SELECT task_id AS entity_id, seq, ts, CASE event WHEN 'claim' THEN 'ANALYZING' WHEN 'renew' THEN 'WRITING' WHEN 'complete' THEN 'REVIEWING'
           WHEN 'fail' THEN 'DRAFT' WHEN 'requeue' THEN 'PLANNING' ELSE 'APPROVED' END AS stage FROM {task_events}"""


@entry(
    "chk_stage_transitions",
    ("task_events",),
    f"""SELECT entity_id, seq, from_stage, stage AS to_stage FROM (SELECT *, lag(stage) OVER (PARTITION BY entity_id ORDER BY ts, seq) AS from_stage FROM ({_AUDIT.format(task_events='task_events')}))
        WHERE from_stage IS NOT NULL AND from_stage <> stage AND (from_stage, stage) NOT IN ({', '.join(str(t) for t in ck.STAGE_TRANSITIONS)})""",
)
def chk_stage_transitions(spark, sf_dir):
    return ck.forbidden_transitions(spark.sql(_AUDIT, task_events=derive(spark, sf_dir, "task_events")))


_ASSETS = """
    SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name,
           CASE p_size % 5 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'DISABLED' ELSE 'AVAILABLE' END AS status,
           CASE WHEN p_size % 7 = 1 THEN 'PENDING' ELSE 'APPROVED' END AS approval_status,
           CASE WHEN p_size % 6 = 2 THEN NULL ELSE TIMESTAMP '2026-01-01 00:00:00' + CAST(p_partkey % 400 AS INT) * INTERVAL '1' DAY END AS effective_at,
           CASE WHEN p_size % 4 = 3 THEN NULL ELSE TIMESTAMP '2026-05-01 00:00:00' + CAST(p_partkey % 300 AS INT) * INTERVAL '1' DAY END AS expires_at
    FROM {part}"""


@entry(
    "q_available_assets",
    (),
    f"""SELECT id, name, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at FROM ({_ASSETS.format(part='part')})
        WHERE status = 'AVAILABLE' AND approval_status = 'APPROVED' AND (effective_at IS NULL OR effective_at <= TIMESTAMP '2026-07-10 00:00:00')
          AND (expires_at IS NULL OR expires_at > TIMESTAMP '2026-07-10 00:00:00')""",
)
def q_available_assets(spark, sf_dir):
    assets = spark.sql(_ASSETS, part=table(spark, sf_dir, "part"))
    return ck.available_assets(assets, F.lit("2026-07-10 00:00:00").cast("timestamp"))


@entry("chk_duplicate_content")
def chk_duplicate_content(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return ck.duplicate_content(documents)
