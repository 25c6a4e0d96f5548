"""Data-quality checks over the derived relational tables and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv
from clauseloom.operators import blocks as bl
from clauseloom.operators import quality as dq
from clauseloom.operators import requirements as rq
from clauseloom.plans.catalog import entry
from clauseloom.plans.oracle_parts import trim, u16
from clauseloom.plans.text_queries import canonical
from clauseloom.sources.derived import corpus, derive, table

_NAME_OK = f"name IS NOT NULL AND {u16(trim('name'))} BETWEEN 1 AND 160"


def _opt(name: str) -> str:
    return f"CASE WHEN {name} <> '' THEN {trim(name)} END AS {name}"


@entry(
    "dq_project_fields",
    ("project_forms",),
    f"""SELECT form_id, {trim('name')} AS name, {_opt('code')}, {_opt('customer_name')}, {_opt('owner_name')},
               CASE WHEN NOT ({_NAME_OK}) THEN 'INVALID_PROJECT_NAME'
                    WHEN coalesce({u16(trim('code'))}, 0) > 80 OR coalesce({u16(trim('customer_name'))}, 0) > 160
                      OR coalesce({u16(trim('owner_name'))}, 0) > 160 THEN 'INVALID_BODY' END AS reject_reason
        FROM project_forms""",
)
def dq_project_fields(spark, sf_dir):
    return dq.project_fields(derive(spark, sf_dir, "project_forms"))


_R = fv.RFC3339
_LOCAL = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})(?::(\d{2}))?$"


@entry(
    "dq_rfc3339",
    ("project_forms",),
    f"""SELECT form_id, deadline,
               CASE WHEN regexp_matches(deadline, '{_R}') AND substr(deadline, 18, 2) <= '59'
                     AND (oh = '' OR (CAST(oh AS INT) <= 23 AND CAST(om AS INT) <= 59))
                    THEN strftime(try_strptime(replace(substr(deadline, 1, 19), 't', 'T'), '%Y-%m-%dT%H:%M:%S')
                         - CASE WHEN sign = '-' THEN -1 ELSE 1 END * to_minutes(CAST(coalesce(nullif(oh, ''), '0') AS INT) * 60
                         + CAST(coalesce(nullif(om, ''), '0') AS INT)), '%Y-%m-%dT%H:%M:%S.')
                         || rpad(substr(regexp_extract(deadline, '{_R}', 7), 2, 3), 3, '0') || 'Z' END AS utc,
               CASE WHEN regexp_matches(deadline, '{_LOCAL}') THEN strftime(try_strptime(
                    CASE WHEN length(deadline) = 16 THEN deadline || ':00' ELSE deadline END, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%d %H:%M:%S') END AS local_time
        FROM (SELECT *, regexp_extract(deadline, '[+-](\\d{{2}}):(\\d{{2}})$', 1) AS oh, regexp_extract(deadline, '[+-](\\d{{2}}):(\\d{{2}})$', 2) AS om,
                     regexp_extract(deadline, '([+-])\\d{{2}}:\\d{{2}}$', 1) AS sign FROM project_forms)""",
)
def dq_rfc3339(spark, sf_dir):
    value = F.col("deadline")
    return derive(spark, sf_dir, "project_forms").select(
        "form_id", "deadline", dq.rfc3339(value).alias("utc"), dq.local_date_time(value).alias("local_time")
    )


_ULID_SQL = "CASE WHEN length(base_id) = 26 THEN substr(base_id, 1, 25) || id_tail ELSE base_id END"


@entry(
    "dq_ulid",
    ("uploads",),
    f"SELECT upload_id, {_ULID_SQL} AS id, regexp_matches({_ULID_SQL}, '{fv.ULID}') AS is_ulid FROM uploads",
)
def dq_ulid(spark, sf_dir):
    made = F.when(
        F.length("base_id") == 26, F.concat(F.substring("base_id", 1, 25), "id_tail")
    ).otherwise(F.col("base_id"))
    rows = derive(spark, sf_dir, "uploads").select("upload_id", made.alias("id"))
    return rows.withColumn("is_ulid", F.col("id").rlike(fv.ULID))


@entry(
    "dq_tenant_id",
    ("uploads",),
    f"SELECT upload_id, tenant_id, regexp_matches(tenant_id, '{fv.TENANT_ID}') AS is_tenant FROM uploads",
)
def dq_tenant_id(spark, sf_dir):
    return derive(spark, sf_dir, "uploads").select(
        "upload_id", "tenant_id", F.col("tenant_id").rlike(fv.TENANT_ID).alias("is_tenant")
    )


_UPLOAD_NAME = trim(r"string_split(regexp_replace(replace(raw_name, chr(92), '/'), '/+$', ''), '/')[-1]")
UPLOAD_CHECKED = f"""
    SELECT *, CASE WHEN length(name) = 0 OR length(name) > 255 THEN 'INVALID_FILE_NAME'
                   WHEN lower(regexp_extract(name, '(?s)^.+?(\\.[^.]*)$', 1)) NOT IN ('.pdf', '.docx', '.txt') THEN 'UNSUPPORTED_FILE_TYPE'
                   WHEN size_bytes > {fv.MAX_UPLOAD_BYTES} THEN 'FILE_TOO_LARGE' WHEN size_bytes = 0 THEN 'EMPTY_FILE' END AS reject_reason
    FROM (SELECT *, {_UPLOAD_NAME} AS name FROM uploads)"""


@entry("dq_upload", ("uploads",), f"SELECT upload_id, name, size_bytes, reject_reason FROM ({UPLOAD_CHECKED})")
def dq_upload(spark, sf_dir):
    rows = derive(spark, sf_dir, "uploads").withColumn("name", dq.upload_name(F.col("raw_name")))
    return rows.select(
        "upload_id", "name", "size_bytes",
        dq.upload_reason(F.col("name"), F.col("size_bytes")).alias("reject_reason"),
    )


@entry(
    "dq_format_route",
    ("project_files",),
    f"""SELECT id, file_name, reject_reason, CASE WHEN reject_reason IS NULL THEN substr(ext, 2) END AS format FROM (
          SELECT *, CASE WHEN expected IS NOT NULL AND expected <> essence THEN 'FORMAT_MISMATCH'
                         WHEN expected IS NULL AND essence IN ('text/plain', 'application/pdf', '{fv.DOCX_MEDIA_TYPE}') THEN 'FORMAT_MISMATCH'
                         WHEN expected IS NULL THEN 'UNSUPPORTED_DOCUMENT_FORMAT'
                         WHEN ext = '.docx' AND size_bytes % 3 = 0 THEN 'FORMAT_MISMATCH' END AS reject_reason
          FROM (SELECT *, CASE ext WHEN '.txt' THEN 'text/plain' WHEN '.pdf' THEN 'application/pdf' WHEN '.docx' THEN '{fv.DOCX_MEDIA_TYPE}' END AS expected
                FROM (SELECT *, lower(regexp_extract(file_name, '\\.[^.]*$')) AS ext, lower(trim(split_part(media_type, ';', 1))) AS essence
                      FROM project_files)))""",
)
def dq_format_route(spark, sf_dir):
    files = derive(spark, sf_dir, "project_files").select(
        "id", "file_name", "media_type",
        F.when(F.col("size_bytes") % 3 == 0, "%PDF-1.7").otherwise("PK").alias("head"),
    )
    return dq.route_formats(files).select("id", "file_name", "reject_reason", "format")


@entry(
    "dq_integrity",
    (),
    """SELECT doc_id, CASE WHEN declared <> actual THEN 'SIZE_MISMATCH' WHEN NOT regexp_matches(stored, '^[0-9a-f]{64}$') THEN 'DIGEST_NOT_LOWERCASE_HEX'
                           WHEN stored <> digest THEN 'DIGEST_MISMATCH' END AS reason
       FROM (SELECT doc_id, strlen(text) AS actual, strlen(text) + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS declared, sha256(text) AS digest,
                    CASE WHEN doc_id % 13 = 0 THEN upper(sha256(text)) WHEN doc_id % 11 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS stored
             FROM documents)""",
)
def dq_integrity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    content, key = F.col("text").cast("binary"), F.col("doc_id")
    actual, digest = F.octet_length(content), F.sha2(content, 256)
    declared = actual + F.when(key % 17 == 0, 1).otherwise(0)
    stored = (
        F.when(key % 13 == 0, F.upper(digest))
        .when(key % 11 == 0, F.sha2(F.concat("text", F.lit("x")), 256))
        .otherwise(digest)
    )
    return docs.select("doc_id", dq.integrity_reason(declared, actual, stored, digest).alias("reason"))


@entry(
    "dq_lineage_orphans",
    ("parse_tasks", "project_files", "requirements"),
    """SELECT 'task' AS entity, tenant_id, id FROM parse_tasks t WHERE NOT EXISTS (SELECT 1 FROM project_files f
              WHERE f.tenant_id = t.tenant_id AND f.project_id = t.project_id AND f.id = t.file_id)
       UNION ALL
       SELECT 'requirement', tenant_id, id FROM requirements r WHERE NOT EXISTS (SELECT 1 FROM parse_tasks t
              WHERE t.tenant_id = r.tenant_id AND t.project_id = r.project_id AND t.file_id = r.file_id AND t.id = r.task_id)""",
)
def dq_lineage_orphans(spark, sf_dir):
    return dq.lineage_orphans(*[derive(spark, sf_dir, n) for n in ("parse_tasks", "project_files", "requirements")])


@entry(
    "dq_unique_keys",
    ("project_files", "requirements"),
    """SELECT 'files.etag' AS check_name, object_etag AS key, count(*) AS copies FROM project_files WHERE object_etag IS NOT NULL
       GROUP BY object_etag HAVING count(*) > 1
       UNION ALL SELECT 'requirements.file_code', tenant_id || '/' || file_id || '/' || code, count(*) FROM requirements
       GROUP BY tenant_id, file_id, code HAVING count(*) > 1
       UNION ALL SELECT 'requirements.task_code', tenant_id || '/' || task_id || '/' || code, count(*) FROM requirements
       GROUP BY tenant_id, task_id, code HAVING count(*) > 1""",
)
def dq_unique_keys(spark, sf_dir):
    files, requirements = (derive(spark, sf_dir, n) for n in ("project_files", "requirements"))
    return (
        dq.duplicate_keys(files, "files.etag", "object_etag")
        .unionByName(dq.duplicate_keys(requirements, "requirements.file_code", "tenant_id", "file_id", "code"))
        .unionByName(dq.duplicate_keys(requirements, "requirements.task_code", "tenant_id", "task_id", "code"))
    )


@entry(
    "dq_state_shapes",
    ("parse_tasks", "outbox", "project_files"),
    """SELECT 'task' AS entity, id, 'lease_shape' AS rule FROM parse_tasks WHERE NOT (
          (status = 'running' AND lease_token IS NOT NULL AND trim(lease_token) <> '' AND lease_owner IS NOT NULL AND trim(lease_owner) <> '' AND lease_expires_at IS NOT NULL)
          OR (status <> 'running' AND lease_token IS NULL AND lease_owner IS NULL AND lease_expires_at IS NULL))
       UNION ALL SELECT 'task', id, 'dead_letter_shape' FROM parse_tasks WHERE NOT (dead_lettered_at IS NULL OR status = 'failed')
       UNION ALL SELECT 'outbox', id, 'outbox_lease_shape' FROM outbox WHERE NOT ((lease_owner IS NULL AND lease_expires_at IS NULL)
          OR (lease_owner IS NOT NULL AND trim(lease_owner) <> '' AND lease_expires_at IS NOT NULL))
       UNION ALL SELECT 'outbox', id, 'published_has_no_lease' FROM outbox WHERE NOT (published_at IS NULL OR (lease_owner IS NULL AND lease_expires_at IS NULL))
       UNION ALL SELECT 'file', id, 'storage_source' FROM project_files WHERE NOT (
          (object_key IS NULL AND object_etag IS NULL AND object_stored_at IS NULL AND content IS NOT NULL)
          OR (object_key IS NOT NULL AND trim(object_key) <> '' AND object_stored_at IS NOT NULL))""",
)
def dq_state_shapes(spark, sf_dir):
    return dq.state_shape_violations(*[derive(spark, sf_dir, n) for n in ("parse_tasks", "outbox", "project_files")])


@entry(
    "dq_evidence_shapes",
    ("requirements",),
    """SELECT 'requirement' AS entity, id, 'confidence' AS rule FROM requirements WHERE NOT (
          (extraction_method = 'development-fixture' AND confidence IS NULL)
          OR (extraction_method = 'deterministic-rules-v1' AND confidence IS NOT NULL AND confidence BETWEEN 0 AND 1))
       UNION ALL SELECT 'requirement', id, 'evidence_kind' FROM requirements WHERE NOT (
          (extraction_method = 'development-fixture' AND coalesce(json_extract_string(locator_json, '$.kind') = 'development-fixture', false))
          OR (extraction_method = 'deterministic-rules-v1' AND coalesce(json_extract_string(locator_json, '$.kind') IN ('pdf', 'docx', 'txt'), false)
              AND coalesce(json_type(locator_json, '$.version') IN ('UBIGINT', 'BIGINT') AND json_extract_string(locator_json, '$.version') = '1', false)))""",
)
def dq_evidence_shapes(spark, sf_dir):
    return dq.evidence_shape_violations(derive(spark, sf_dir, "requirements"))


SMALL_LIMITS = {"bytes": 14_000, "units": 12_000, "blocks": 40, "requirements": 12, "spans": 60, "pages": 2}
_EXCEEDED = ", ".join(f"CASE WHEN {name} > {limit} THEN '{name}' END" for name, limit in SMALL_LIMITS.items())


@entry(
    "dq_resource_limits",
    ("extracted", "line_blocks", "text_runs"),
    f"""SELECT * FROM (SELECT *, concat_ws('|', {_EXCEEDED}) AS exceeded FROM (
          SELECT doc_id, bytes, units, blocks, requirements, blocks AS spans, 0 AS pages
          FROM (SELECT c.doc_id, strlen(c.text) AS bytes, {u16('c.text')} AS units,
                       (SELECT count(*) FROM line_blocks b WHERE b.doc_id = c.doc_id) AS blocks,
                       (SELECT count(*) FROM extracted e WHERE e.doc_id = c.doc_id) AS requirements FROM canon c)
          UNION ALL SELECT doc_id, CAST(sum(strlen(text)) AS BIGINT), CAST(sum({u16('text')}) AS BIGINT), 0, 0, count(*), count(DISTINCT page) FROM text_runs GROUP BY doc_id)) WHERE exceeded <> ''""",
)
def dq_resource_limits(spark, sf_dir):
    docs = canonical(spark, sf_dir)
    sizes = dq.document_sizes(docs, bl.line_blocks(docs), rq.extract_txt_requirements(corpus(spark, sf_dir)))
    pages = dq.page_document_sizes(derive(spark, sf_dir, "text_runs"))
    return dq.over_limit_documents(sizes.unionByName(pages), SMALL_LIMITS)


# Spans of six units every eight, with defects planted by number: shifted, too long, empty, out of every block.
_BLOCK_SPANS = """
    SELECT doc_id, block_no + CASE WHEN k % 37 = 11 THEN 1000000 ELSE 0 END AS block_no, span_no, span_start - CASE WHEN k % 29 = 7 THEN 4 ELSE 0 END AS span_start,
           CASE WHEN k % 31 = 5 THEN span_start WHEN k % 23 = 3 THEN text_end + 1 ELSE span_end END AS span_end
    FROM (SELECT doc_id, block_no, i AS span_no, text_start + i * 8 AS span_start, least(text_start + i * 8 + 6, text_end) AS span_end, text_end, line_no * 5 + i AS k
          FROM {spans})"""
_BLOCK_SPAN_ROWS = "(SELECT *, unnest(range(0, (text_end - text_start + 7) // 8)) AS i FROM line_blocks)"


@entry(
    "dq_block_spans",
    ("line_blocks",),
    f"""SELECT * FROM (SELECT s.doc_id, s.block_no, s.span_no, CASE WHEN b.doc_id IS NULL THEN 'NO_BLOCK'
               WHEN span_end <= span_start OR span_start < text_start OR span_end > text_end THEN 'SPAN_RANGE' WHEN span_start < previous_end THEN 'SPAN_ORDER' END AS reason
        FROM (SELECT *, coalesce(lag(span_end) OVER (PARTITION BY doc_id, block_no ORDER BY span_no), -1) AS previous_end FROM ({_BLOCK_SPANS.format(spans=_BLOCK_SPAN_ROWS)})) s
        LEFT JOIN line_blocks b ON b.doc_id = s.doc_id AND b.block_no = s.block_no) WHERE reason IS NOT NULL""",
)
def dq_block_spans(spark, sf_dir):
    blocks = bl.line_blocks(canonical(spark, sf_dir))
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.col("text_end") - F.col("text_start") + 7) / 8) - 1)
    spans = spark.sql(_BLOCK_SPANS, spans=blocks.select("*", F.explode(numbers).alias("i")))
    return dq.block_span_violations(blocks, spans)


# Defects planted by line number: shifted starts, clipped ends, changed text, dropped lines.
_PLANTED = """
    SELECT doc_id, block_no, text_start - CASE WHEN line_no % 11 = 7 THEN 2 ELSE 0 END AS text_start,
           text_end - CASE WHEN line_no % 13 = 5 THEN 1 ELSE 0 END AS text_end,
           CASE WHEN line_no % 17 = 3 THEN upper(line) ELSE line END AS line
    FROM line_blocks"""
# One unit per character: astral characters become a two-character stand-in.
_FLAT = r"regexp_replace({}, '[\x{{10000}}-\x{{10FFFF}}]', chr(57345) || chr(57346), 'g')"


def planted_blocks(spark, sf_dir):
    n = F.col("line_no")
    return bl.line_blocks(canonical(spark, sf_dir)).select(
        "doc_id", "block_no",
        (F.col("text_start") - F.when(n % 11 == 7, 2).otherwise(0)).alias("text_start"),
        (F.col("text_end") - F.when(n % 13 == 5, 1).otherwise(0)).alias("text_end"),
        F.when(n % 17 == 3, F.upper("line")).otherwise(F.col("line")).alias("line"),
    )


@entry(
    "dq_blocks",
    ("line_blocks", "canon"),
    f"""SELECT * FROM (SELECT b.doc_id, b.block_no,
               CASE WHEN text_start < 0 OR text_end <= text_start OR text_end > length(flat) THEN 'RANGE'
                    WHEN text_start < prev_end THEN 'OVERLAP'
                    WHEN substr(flat, text_start + 1, text_end - text_start) <> {_FLAT.format('line')} THEN 'SLICE' END AS reason
        FROM (SELECT *, coalesce(lag(text_end) OVER (PARTITION BY doc_id ORDER BY block_no), -1) AS prev_end FROM ({_PLANTED})) b
        JOIN (SELECT doc_id, {_FLAT.format('text')} AS flat FROM canon) c ON c.doc_id = b.doc_id) WHERE reason IS NOT NULL""",
)
def dq_blocks(spark, sf_dir):
    return dq.block_violations(canonical(spark, sf_dir), planted_blocks(spark, sf_dir))


@entry(
    "dq_txt_coverage",
    ("line_blocks", "canon"),
    f"""SELECT c.doc_id, count(*) FILTER (WHERE gap_end > gap_start AND regexp_matches(substr(flat, gap_start + 1, gap_end - gap_start), '[^\\n]')) AS hidden_gaps
        FROM (SELECT doc_id, {_FLAT.format('text')} AS flat FROM canon) c LEFT JOIN (
          SELECT doc_id, coalesce(lag(text_end) OVER w, 0) AS gap_start, text_start AS gap_end FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)
          UNION ALL
          SELECT c.doc_id, coalesce(max(k.text_end), 0), max(length({_FLAT.format('c.text')})) FROM canon c LEFT JOIN kept k ON k.doc_id = c.doc_id GROUP BY c.doc_id
        ) g ON g.doc_id = c.doc_id GROUP BY c.doc_id""".replace(
        "kept", "(SELECT * FROM line_blocks WHERE NOT contains(line, 'un'))"
    ),
)
def dq_txt_coverage(spark, sf_dir):
    docs = canonical(spark, sf_dir)
    return dq.uncovered_text(docs, bl.line_blocks(docs).filter("NOT contains(line, 'un')"))


@entry(
    "dq_join_rebuild",
    ("line_blocks", "canon"),
    """SELECT c.doc_id, coalesce(r.rebuilt, '') = c.text AS matches FROM canon c LEFT JOIN
         (SELECT doc_id, string_agg(line, chr(10) ORDER BY block_no) AS rebuilt FROM line_blocks GROUP BY doc_id) r ON r.doc_id = c.doc_id""",
)
def dq_join_rebuild(spark, sf_dir):
    docs = canonical(spark, sf_dir)
    return docs.join(bl.rebuilt_text(bl.line_blocks(docs)), "doc_id", "left").select(
        "doc_id", (F.coalesce("rebuilt", F.lit("")) == F.col("text")).alias("matches")
    )


_SPANS = """
    SELECT id, kind, CASE WHEN line = 6 THEN 'txt' ELSE kind END AS format, page - 1 AS page,
           page / 40.0 - CASE WHEN line = 5 THEN 0.9 ELSE 0.0 END AS x, line / 10.0 AS y, column_no / 60.0 AS width, column_no / 60.0 AS height,
           column_no AS char_start, column_no + page AS char_end, column_no * 3 AS text_start,
           column_no * 3 + page + CASE WHEN line = 3 THEN 1 ELSE 0 END AS text_end,
           CASE WHEN line = 2 AND page % 2 = 0 THEN -1 ELSE page END AS paragraph_index, CASE WHEN line = 4 THEN -1 ELSE line END AS cell,
           line AS start_line, line + CASE WHEN page = 9 THEN 1 ELSE 0 END AS end_line, column_no AS start_col, column_no + page AS end_col
    FROM requirements WHERE kind <> 'development-fixture'"""


@entry(
    "dq_span_sources",
    ("requirements",),
    f"""SELECT id, kind, CASE WHEN kind <> format THEN 'KIND'
               WHEN kind = 'pdf' AND (page < 1 OR x < 0 OR y < 0 OR width <= 0 OR height <= 0 OR x + width > 1 OR y + height > 1) THEN 'PDF_BOX'
               WHEN kind = 'docx' AND (paragraph_index < 0 OR cell < 0 OR char_end <= char_start OR char_end - char_start <> text_end - text_start) THEN 'DOCX_RANGE'
               WHEN kind = 'txt' AND (start_line <> end_line OR end_col - start_col <> text_end - text_start) THEN 'TXT_POSITION' END AS reason
        FROM ({_SPANS.replace('40.0', '40.0::DOUBLE').replace('10.0', '10.0::DOUBLE').replace('60.0', '60.0::DOUBLE').replace('0.9', '0.9::DOUBLE')})""",
)
def dq_span_sources(spark, sf_dir):
    text = _SPANS.replace("FROM requirements", "FROM {requirements}")
    for number in ("40.0", "10.0", "60.0", "0.9"):
        text = text.replace(number, f"CAST({number} AS DOUBLE)")
    spans = spark.sql(text, requirements=derive(spark, sf_dir, "requirements"))
    return spans.withColumn("table_path", F.array(F.lit(0), F.col("cell"))).select(
        "id", "kind", dq.span_reason().alias("reason")
    )


@entry(
    "dq_failure_codes",
    ("parse_tasks",),
    f"""SELECT id, json_extract_string(error, '$.code') AS code,
               CASE WHEN json_extract_string(error, '$.code') IN {fv.FAILURE_CODES} THEN 'permanent'
                    WHEN json_extract_string(error, '$.code') IN {fv.TRANSIENT_CODES} THEN 'transient' ELSE 'unknown' END AS failure_class
        FROM parse_tasks WHERE error IS NOT NULL""",
)
def dq_failure_codes(spark, sf_dir):
    code = F.from_json("error", dq.ERROR_SCHEMA)["code"]
    failed = derive(spark, sf_dir, "parse_tasks").filter("error IS NOT NULL").select("id", code.alias("code"))
    return failed.withColumn("failure_class", dq.failure_class(F.col("code")))
