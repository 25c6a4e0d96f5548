"""Input tables derived from the provided star schema.

Each derivation is one SQL text understood by Spark and by the oracle engine alike, so both sides
of a comparison start from identical rows. Every derivation is row-wise or an equi-join: keys are
content hashes, never a global row number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.batches import bounded_batches

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

REFERENCE_TIME = "1998-06-01 00:00:00"
PROJECT_TIME = "2026-07-10 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Ten thousand whole texts in a batch would be tens of megabytes, of which workers hold many times as much in lines and sentences.
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_LINE_KEY = (
    "md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), "
    "CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING), "
    "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), "
    "CAST(CAST(l_quantity AS BIGINT) AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING), "
    "l_returnflag, l_linestatus, CAST(CAST(round(l_discount * 100) AS BIGINT) AS STRING), "
    "CAST(CAST(round(l_tax * 100) AS BIGINT) AS STRING)))"
)

# name -> (inputs, SQL); `{x}` stands for the relation called x.
SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    "tender_lines": (
        ("part",),
        """
        SELECT CAST(floor(p_partkey / 24) AS BIGINT) AS doc_no, p_partkey AS seq,
               CAST(p_partkey % 12 AS BIGINT) AS kind,
               CASE p_partkey % 12
                 WHEN 0 THEN concat('# ', p_type, ' parts')
                 WHEN 1 THEN concat('## ', p_name)
                 WHEN 2 THEN concat('Supplier ', CAST(p_partkey AS STRING), ' must deliver ', p_name, '.')
                 WHEN 3 THEN concat('Bidder ', CAST(p_partkey AS STRING), ' SHALL state the price.')
                 WHEN 4 THEN concat('供应商', CAST(p_partkey AS STRING), '必须提交证书。')
                 WHEN 5 THEN concat('供应商', CAST(p_partkey AS STRING), '不得泄露数据。')
                 WHEN 6 THEN concat('方案', CAST(p_partkey AS STRING), '最高可得', CAST(p_size AS STRING), '分。')
                 WHEN 7 THEN concat('Item ', CAST(p_partkey AS STRING), ' is worth ', CAST(p_size AS STRING), ' points.')
                 WHEN 8 THEN '本事项无须另行盖章。'
                 WHEN 9 THEN ''
                 WHEN 10 THEN concat('😀 Plain text v1.2 ok. Licensed vendors shall sign； no signal here ', p_name)
                 ELSE 'The supplier must comply.' END AS line
        FROM {part}""",
    ),
    "projects": (
        ("customer",),
        """
        SELECT concat('P', CAST(c_custkey AS STRING)) AS id,
               concat('t', CAST(c_custkey % 25 AS STRING)) AS tenant_id, c_name AS name,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('C-', CAST(c_custkey % 1000 AS STRING)) END AS code,
               c_mktsegment AS customer_name,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('owner-', CAST(c_custkey % 9 AS STRING)) END AS owner_name,
               CASE WHEN c_custkey % 11 = 0 THEN NULL
                    ELSE TIMESTAMP '2026-07-01 09:30:00' + CAST(c_custkey % 30 AS INT) * INTERVAL '1' DAY END AS deadline,
               CASE c_custkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'active' ELSE 'archived' END AS status,
               TIMESTAMP '2026-06-01 00:00:00' + CAST(c_custkey % 500 AS INT) * INTERVAL '1' HOUR AS created_at,
               TIMESTAMP '2026-06-01 00:00:00' + CAST(c_custkey % 700 AS INT) * INTERVAL '1' HOUR AS updated_at,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 14 END AS risks,
               CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_custkey % 101 END AS coverage
        FROM {customer}""",
    ),
    "project_files": (
        ("orders",),
        """
        SELECT concat('F', CAST(o_orderkey AS STRING)) AS id,
               concat('t', CAST(o_custkey % 25 AS STRING)) AS tenant_id,
               concat('P', CAST(o_custkey AS STRING)) AS project_id,
               concat('file-', CAST(o_orderkey AS STRING),
                 CASE o_orderkey % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' WHEN 3 THEN '.PDF'
                                     WHEN 4 THEN '.zip' WHEN 5 THEN '.xlsx' WHEN 6 THEN '' ELSE '.doc' END) AS file_name,
               CASE o_orderkey % 6
                 WHEN 0 THEN 'application/pdf'
                 WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
                 WHEN 2 THEN ' Text/Plain ; charset=UTF-8 '
                 WHEN 3 THEN 'application/pdf'
                 WHEN 4 THEN 'application/zip'
                 ELSE 'application/octet-stream' END AS media_type,
               CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE (o_orderkey * 7919) % 31457280 END AS size_bytes,
               concat(md5(CAST(o_orderkey % 1000 AS STRING)), md5(CAST(o_orderkey % 500 AS STRING))) AS sha256,
               CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'P' THEN 'failed'
                    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'queued' ELSE 'parsing' END END AS parse_status,
               CASE WHEN o_orderkey % 10 = 9 THEN NULL
                    ELSE concat('tenants/t', CAST(o_custkey % 25 AS STRING), '/projects/P', CAST(o_custkey AS STRING),
                                '/files/F', CAST(o_orderkey + CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END AS STRING),
                                CASE WHEN o_orderkey % 40 = 2 THEN '/v0/original' ELSE '/v1/original' END) END AS object_key,
               CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE md5(CAST(o_orderkey % 300 AS STRING)) END AS object_etag,
               CASE WHEN o_orderkey % 60 = 3 OR o_orderkey % 10 = 9 THEN NULL ELSE o_orderdate END AS object_stored_at,
               CASE WHEN o_orderkey % 20 = 9 THEN 'inline' ELSE NULL END AS content,
               o_orderdate AS created_at,
               o_orderdate + CAST(o_orderkey % 48 AS INT) * INTERVAL '1' HOUR AS updated_at
        FROM {orders}""",
    ),
    "line_keys": (
        ("lineitem", "orders"),
        f"""
        SELECT {_LINE_KEY} AS line_key, l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
               CAST(l_quantity AS BIGINT) AS quantity, l_shipdate, o_custkey, o_orderstatus, o_orderpriority,
               (l_partkey + l_suppkey + l_linenumber) % 4 AS state_no
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    ),
    "parse_tasks": (
        ("line_keys",),
        """
        SELECT concat('T', substr(line_key, 1, 25)) AS id,
               concat('t', CAST(o_custkey % 25 AS STRING)) AS tenant_id,
               concat('P', CAST(o_custkey + CASE WHEN l_partkey % 199 = 7 THEN 1 ELSE 0 END AS STRING)) AS project_id,
               concat('F', CAST(l_orderkey AS STRING)) AS file_id,
               CASE WHEN l_partkey % 101 = 3 THEN 'legacy-parse' WHEN l_partkey % 5 = 0 THEN 'development-document-parse'
                    ELSE 'document-parse-v1' END AS type,
               CASE state_no WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status,
               CAST(CASE state_no WHEN 0 THEN 0 WHEN 1 THEN 20 WHEN 2 THEN 100 ELSE 20 END AS BIGINT) AS progress,
               quantity % 5 AS attempt,
               CASE WHEN state_no = 3 THEN concat('{{"code":"',
                      CASE l_partkey % 6 WHEN 0 THEN 'OBJECT_STORAGE_UNAVAILABLE' WHEN 1 THEN 'INVALID_DOCX'
                           WHEN 2 THEN 'OCR_REQUIRED' WHEN 3 THEN 'DATABASE_UNAVAILABLE' WHEN 4 THEN 'FORMAT_MISMATCH'
                           ELSE 'SOMETHING_ELSE' END, '","message":"m', CAST(l_suppkey AS STRING), '"}}') END AS error,
               l_shipdate AS created_at,
               CASE WHEN state_no > 0 THEN l_shipdate + CAST(quantity * 3 AS INT) * INTERVAL '1' MINUTE END AS started_at,
               CASE WHEN state_no > 1 THEN l_shipdate + CAST(quantity * 3 + l_linenumber * 7 AS INT) * INTERVAL '1' MINUTE END AS finished_at,
               l_shipdate + CAST(quantity AS INT) * INTERVAL '1' HOUR AS updated_at,
               l_shipdate + CAST(l_suppkey % 50 AS INT) * INTERVAL '1' DAY AS next_attempt_at,
               CASE WHEN state_no = 1 AND l_suppkey % 23 <> 4 THEN concat('worker-', CAST(l_suppkey % 3 AS STRING))
                    WHEN state_no = 2 AND l_suppkey % 41 = 5 THEN 'worker-x' END AS lease_owner,
               CASE WHEN state_no = 1 AND l_suppkey % 29 = 6 THEN '  '
                    WHEN state_no = 1 THEN substr(line_key, 1, 8) END AS lease_token,
               CASE WHEN state_no = 1 THEN l_shipdate + CAST(quantity * 9 AS INT) * INTERVAL '1' DAY END AS lease_expires_at,
               CASE WHEN (state_no = 3 AND l_partkey % 3 = 0) OR (state_no = 2 AND l_suppkey % 43 = 8)
                    THEN l_shipdate + CAST(quantity AS INT) * INTERVAL '1' DAY END AS dead_lettered_at
        FROM {line_keys}""",
    ),
    "requirements": (
        ("line_keys",),
        """
        SELECT concat('R', substr(line_key, 1, 25)) AS id,
               concat('t', CAST(o_custkey % 25 AS STRING)) AS tenant_id,
               concat('P', CAST(o_custkey AS STRING)) AS project_id,
               concat('F', CAST(l_orderkey AS STRING)) AS file_id,
               concat('T', substr(line_key, 1, 25)) AS task_id,
               concat('REQ-', lpad(CAST(l_linenumber * 37 + l_suppkey % 30 AS STRING), 4, '0')) AS code,
               concat('Item ', CAST(l_partkey AS STRING), ' must match 100%_spec ', substr(line_key, 1, 6)) AS title,
               concat('Delivery of ', CAST(quantity AS STRING), ' units') AS description,
               CASE l_partkey % 3 WHEN 0 THEN 'technical' WHEN 1 THEN 'commercial' ELSE 'compliance' END AS category,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'mandatory'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'important' ELSE 'normal' END AS priority,
               CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS confirmation_status,
               CASE WHEN o_orderstatus = 'P' THEN 'not applicable' END AS confirmation_note,
               CASE WHEN o_orderstatus <> 'O' THEN l_shipdate + INTERVAL '1' DAY END AS confirmed_at,
               CASE WHEN l_suppkey % 4 = 3 THEN 'development-fixture' ELSE 'deterministic-rules-v1' END AS extraction_method,
               CASE l_suppkey % 4 WHEN 0 THEN 0.98 WHEN 1 THEN 0.95
                    WHEN 2 THEN CASE WHEN l_partkey % 2 = 0 THEN 0.9 ELSE 0.8 END END AS confidence,
               CASE WHEN l_suppkey % 4 = 3 THEN 'development-fixture' WHEN l_partkey % 3 = 0 THEN 'pdf'
                    WHEN l_partkey % 3 = 1 THEN 'docx' ELSE 'txt' END AS kind,
               concat('{{"kind":"', CASE WHEN l_suppkey % 31 = 7 THEN 'image'
                                        WHEN l_suppkey % 4 = 3 THEN 'development-fixture' WHEN l_partkey % 3 = 0 THEN 'pdf'
                                        WHEN l_partkey % 3 = 1 THEN 'docx' ELSE 'txt' END, '"',
                      CASE l_partkey % 13 WHEN 0 THEN '' WHEN 1 THEN ',"version":2' WHEN 2 THEN ',"version":"1"'
                                          ELSE ',"version":1' END, '}}') AS locator_json,
               concat('file-', CAST(l_orderkey AS STRING)) AS source,
               l_partkey % 40 + 1 AS page, l_linenumber AS line, quantity AS column_no,
               CASE WHEN l_partkey % 6 = 0 THEN '未映射'
                    ELSE concat(CAST(CAST(floor(l_partkey % 50 / 5) AS BIGINT) + 1 AS STRING),
                                CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('.', CAST(l_partkey % 5 AS STRING)) END,
                                ' Topic ', CAST(l_partkey % 50 AS STRING)) END AS section,
               CASE l_suppkey % 5 WHEN 0 THEN '阻断' WHEN 1 THEN '高' WHEN 2 THEN '中' ELSE '低' END AS risk,
               CASE WHEN o_orderstatus = 'F' THEN CASE l_partkey % 4 WHEN 0 THEN '待响应' WHEN 1 THEN '编写中' WHEN 2 THEN '已响应' ELSE '已确认' END
                    ELSE '未确认' END AS status,
               concat('owner-', CAST(l_suppkey % 6 AS STRING)) AS owner,
               l_shipdate AS created_at, l_shipdate + INTERVAL '2' DAY AS updated_at
        FROM {line_keys}""",
    ),
    "outline": (
        ("part",),
        """
        SELECT CAST(p_partkey AS BIGINT) AS id, concat('P', CAST(floor(p_partkey / 50) AS BIGINT)) AS project_id,
               concat(CAST(CAST(floor(p_partkey % 50 / 5) AS BIGINT) + 1 AS STRING),
                      CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('.', CAST(p_partkey % 5 AS STRING)) END) AS number,
               concat('Topic ', CAST(p_partkey % 50 AS STRING)) AS title, p_name AS summary,
               CAST(CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 2 END AS BIGINT) AS level,
               concat('owner-', CAST(p_size % 6 AS STRING)) AS owner,
               CASE p_size % 4 WHEN 0 THEN '已批准' WHEN 1 THEN '编写中' WHEN 2 THEN '待审核' ELSE '未开始' END AS status,
               CAST(p_size * 100 AS BIGINT) AS target_words, CAST(p_size % 7 AS BIGINT) AS requirement_count
        FROM {part}""",
    ),
    "issues": (
        ("customer",),
        """
        SELECT CAST(c_custkey AS BIGINT) AS id, concat('P', CAST(CAST(floor(c_custkey % 500 / 5) AS BIGINT) AS STRING)) AS project_id,
               concat('Issue ', c_name) AS title,
               CASE c_custkey % 3 WHEN 0 THEN '阻断' WHEN 1 THEN '重要' ELSE '一般' END AS severity,
               CASE c_custkey % 4 WHEN 0 THEN concat(CAST(c_custkey % 10 + 1 AS STRING), '.', CAST(c_custkey % 4 + 1 AS STRING), '.3 detail')
                                  WHEN 1 THEN concat('see Topic ', CAST(c_custkey % 50 AS STRING))
                                  WHEN 2 THEN concat(CAST(c_custkey % 10 + 1 AS STRING), ' Topic ', CAST(c_custkey % 50 AS STRING))
                                  ELSE 'appendix' END AS location,
               CASE WHEN c_nationkey % 3 = 0 THEN '已解决' ELSE '待处理' END AS status,
               concat('owner-', CAST(c_custkey % 6 AS STRING)) AS owner
        FROM {customer}""",
    ),
    "task_events": (
        ("events",),
        """
        SELECT event_id AS seq, concat('t', CAST(user_id % 5 AS STRING)) AS tenant_id,
               concat('T', CAST(user_id AS STRING)) AS task_id, concat('F', CAST(user_id % 40 AS STRING)) AS file_id,
               CASE event_type WHEN 'signup' THEN 'claim' WHEN 'view' THEN 'renew' WHEN 'click' THEN 'complete'
                    WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'fail' ELSE 'requeue' END ELSE 'retry' END AS event,
               ts, ts + INTERVAL '6' HOUR AS lease_expires_at,
               CASE WHEN event_type = 'error' THEN
                    CASE WHEN event_id % 3 = 0 THEN 'INVALID_DOCX' ELSE 'OBJECT_STORAGE_UNAVAILABLE' END END AS error_code,
               event_id % 4 = 0 AS forged
        FROM {events}""",
    ),
    # A non-claim event acts under the newest claim of its task (token = that claim's seq); forged
    # events carry a token nobody holds.
    "task_log": (
        ("task_events",),
        """
        SELECT seq, tenant_id, task_id, file_id, event, ts, lease_expires_at, error_code,
               CASE WHEN event = 'claim' THEN seq WHEN forged THEN seq * 0 - 1 ELSE newest_claim END AS token
        FROM (SELECT *, max(CASE WHEN event = 'claim' THEN seq END)
                        OVER (PARTITION BY task_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newest_claim
              FROM {task_events}) held""",
    ),
    # Positioned text: a document per part, 24 runs per page, five page designs (document % 5):
    # 0 table, 1 staggered columns, 2 flowing text, 3 flowing text with rotated, clipped, blank and
    # right-to-left runs, 4 headings. Coordinates are PDF user space; the viewport flips y.
    "text_runs": (
        ("line_keys",),
        """
        SELECT doc_id, page, item_index, text, k, idx,
               CASE WHEN rotated THEN CAST(0 AS DOUBLE) ELSE size END AS t0, CASE WHEN rotated THEN size ELSE CAST(0 AS DOUBLE) END AS t1,
               CASE WHEN rotated THEN -size ELSE CAST(0 AS DOUBLE) END AS t2, CASE WHEN rotated THEN CAST(0 AS DOUBLE) ELSE size END AS t3,
               x AS t4, CAST(842 AS DOUBLE) - y AS t5, length(text) * size * CAST(0.5 AS DOUBLE) AS width,
               CASE WHEN quantity % 10 = 0 THEN CAST(5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS ascent, CAST(-0.2 AS DOUBLE) AS descent,
               CASE WHEN k = 3 AND idx % 12 = 3 THEN 'rtl' ELSE 'ltr' END AS dir, false AS vertical,
               k IN (1, 4) OR idx % 2 = 1 AS has_eol, CAST(1 AS DOUBLE) AS v0, CAST(0 AS DOUBLE) AS v1, CAST(0 AS DOUBLE) AS v2,
               CAST(-1 AS DOUBLE) AS v3, CAST(0 AS DOUBLE) AS v4, CAST(842 AS DOUBLE) AS v5, CAST(595 AS DOUBLE) AS page_width, CAST(842 AS DOUBLE) AS page_height
        FROM (
          SELECT *, k = 3 AND idx % 6 = 5 AS rotated,
                 CASE WHEN k = 4 AND idx % 8 = 0 THEN CAST(20 AS DOUBLE) WHEN k = 4 AND idx % 4 = 0 THEN CAST(18 AS DOUBLE) ELSE CAST(12 AS DOUBLE) END AS size,
                 CASE k WHEN 0 THEN 60 + floor(idx / 2) * 24 WHEN 1 THEN 60 + floor(idx / 2) * 40 + idx % 2 * 15
                        WHEN 4 THEN 60 + idx * 22 + floor(idx / 4) * 22 + floor((idx + 3) / 4) * 22
                        ELSE 60 + floor(idx / 2) * 20 + idx % 2 * CAST(0.5 AS DOUBLE) END AS y,
                 CASE WHEN k = 3 AND idx % 12 = 7 THEN CAST(700 AS DOUBLE) WHEN k = 0 THEN 72 + idx % 2 * CAST(258 AS DOUBLE)
                      WHEN k = 1 THEN 72 + idx % 2 * CAST(268 AS DOUBLE) WHEN k = 4 AND idx % 8 = 4 THEN CAST(262 AS DOUBLE)
                      WHEN k IN (2, 3) THEN 72 + idx % 2 * CAST(190 AS DOUBLE) ELSE CAST(72 AS DOUBLE) END AS x
          FROM (
            SELECT concat('p-', CAST(l_partkey AS STRING)) AS doc_id, CAST(floor(r / 24) AS BIGINT) + 1 AS page, CAST(r % 24 AS BIGINT) AS item_index,
                   CAST(r % 24 AS BIGINT) AS idx, l_partkey % 5 AS k, quantity,
                   CASE WHEN l_partkey % 5 = 3 AND r % 12 = 9 THEN '   '
                        WHEN l_partkey % 5 = 4 AND r % 8 = 0 THEN concat(CAST(l_linenumber AS STRING), '. Scope')
                        WHEN l_partkey % 5 = 4 AND r % 8 = 4 THEN 'Area'
                        WHEN l_partkey % 5 IN (2, 3) AND r % 2 = 0 THEN rpad(concat('Lot ', CAST(l_linenumber AS STRING), ' must ship all of it today'), 31, '.')
                        WHEN r % 3 = 1 THEN concat('Seal ', CAST(quantity AS STRING), ' shall hold.')
                        ELSE concat('Context ', CAST(l_suppkey AS STRING)) END AS text
            FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, line_key) - 1 AS r FROM {line_keys}) numbered) placed) sized""",
    ),
    # A notice per order: what its project's customer row says, written in turn in many ways; some notices say otherwise.
    "notices": (
        ("orders",),
        """
        SELECT doc_id, tenant_id, project_id, odd, day, amount, days,
               concat('# ', CASE style WHEN 0 THEN 'Tender notice' ELSE '招标公告' END, chr(10),
                 CASE style WHEN 0 THEN 'Project name: ' WHEN 1 THEN '项目名称：' ELSE '1. 项目名称: ' END, CASE style WHEN 2 THEN upper(name) ELSE name END, CASE style WHEN 1 THEN '。' ELSE '' END, chr(10),
                 'The supplier must comply with 3 points: all of them.', chr(10),
                 CASE style WHEN 0 THEN 'Bid deadline: ' ELSE '投标截止时间：' END,
                 CASE form WHEN 0 THEN concat('2026-', lpad(CAST(month AS STRING), 2, '0'), '-', lpad(CAST(day AS STRING), 2, '0'), ' 09:30')
                           WHEN 1 THEN concat('2026年', CAST(month AS STRING), '月', CAST(day AS STRING), '日上午9时')
                           WHEN 2 THEN concat(substr('JanuaryFebruaryMarchAprilMayJuneJulyAugustSeptember', CAST(substr('010816212629333743', CAST(month * 2 - 1 AS INT), 2) AS INT), 3), ' ', CAST(day AS STRING), ', 2026')
                           WHEN 3 THEN concat(CAST(day AS STRING), ' ', substr('JanFebMarAprMayJunJulAugSep', CAST(month * 3 - 2 AS INT), 3), ' 2026')
                           ELSE concat('二〇二六年', substr('一二三四五六七八九', CAST(month AS INT), 1), '月', CASE WHEN day < 20 THEN '十' ELSE '二十' END, CASE WHEN day % 10 = 0 THEN '' ELSE substr('一二三四五六七八九', CAST(day % 10 AS INT), 1) END, '日') END, chr(10),
                 CASE style WHEN 0 THEN 'Budget: ' WHEN 1 THEN '预算金额：' ELSE '最高限价：' END,
                 CASE form WHEN 0 THEN concat('RMB ', CAST(CAST(floor(amount / 100) AS BIGINT) AS STRING), ',', lpad(CAST(amount % 100 * 10 AS STRING), 3, '0'), ',000') WHEN 1 THEN concat('人民币', CAST(amount AS STRING), '万元') WHEN 2 THEN concat('¥', CAST(amount * 10000 AS STRING), '.00')
                           WHEN 3 THEN concat('CNY ', CAST(amount * 10 AS STRING), ' thousand') ELSE concat(substr('一二三四五六七八九', CAST(floor(amount / 100) AS INT), 1), '百', substr('一二三四五六七八九', CAST(floor(amount % 100 / 10) AS INT), 1), '十', substr('一二三四五六七八九', CAST(amount % 10 AS INT), 1), '万元整') END, chr(10),
                 CASE style WHEN 0 THEN 'Duration: ' ELSE '工期：' END, CASE WHEN odd = 3 THEN 'to be agreed' WHEN form = 1 THEN concat(CAST(days AS STRING), '日历天') WHEN form = 2 THEN concat(CAST(CAST(floor(days / 7) AS BIGINT) AS STRING), ' weeks') ELSE concat(CAST(days AS STRING), ' calendar days') END) AS text
        FROM (SELECT *, CASE WHEN odd = 1 THEN base_day % 19 + 10 + CASE WHEN base_day % 19 = 18 THEN -1 ELSE 1 END ELSE base_day % 19 + 10 END AS day,
                     (CAST(substr(CAST(customer % 9 + 1 AS STRING), 1, 1) AS BIGINT)) * 100 + (customer % 8 + 1) * 10 + CASE WHEN odd = 2 THEN (customer + 1) % 9 + 1 ELSE customer % 9 + 1 END AS amount,
                     (customer % 20 + 4) * 7 AS days, customer % 9 + 1 AS month, concat('Works ', CAST(customer AS STRING), ' new site') AS name
              FROM (SELECT concat('N', CAST(o_orderkey AS STRING)) AS doc_id, concat('t', CAST(o_custkey % 25 AS STRING)) AS tenant_id, concat('P', CAST(o_custkey AS STRING)) AS project_id,
                           CAST(o_custkey AS BIGINT) AS customer, CAST(o_custkey AS BIGINT) AS base_day, CAST(o_orderkey % 3 AS BIGINT) AS style, CAST(o_orderkey % 5 AS BIGINT) AS form,
                           CAST(CASE o_orderkey % 37 WHEN 5 THEN 1 WHEN 11 THEN 2 WHEN 17 THEN 3 ELSE 0 END AS BIGINT) AS odd FROM {orders}) keyed) valued""",
    ),
    "project_forms": (
        ("customer",),
        """
        SELECT CAST(c_custkey AS BIGINT) AS form_id,
               CASE c_custkey % 8 WHEN 0 THEN '   ' WHEN 1 THEN repeat('x', 161) WHEN 2 THEN concat('  ', c_name, '　')
                                  WHEN 3 THEN repeat('供', 160) WHEN 4 THEN NULL ELSE c_name END AS name,
               CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN repeat('c', 81) WHEN 2 THEN NULL WHEN 3 THEN '  '
                                  ELSE concat(' C-', CAST(c_custkey AS STRING), ' ') END AS code,
               CASE WHEN c_custkey % 21 = 5 THEN repeat('n', 161) ELSE c_mktsegment END AS customer_name,
               CASE WHEN c_custkey % 23 = 5 THEN repeat('o', 170) ELSE concat('owner-', CAST(c_custkey % 9 AS STRING)) END AS owner_name,
               CASE c_custkey % 18
                 WHEN 0 THEN concat('2026-07-', lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'), 'T09:30:00Z')
                 WHEN 1 THEN '2026-02-29T10:00:00Z' WHEN 2 THEN '2024-02-29T10:00:00+08:00'
                 WHEN 3 THEN concat('2026-', lpad(CAST(c_custkey % 20 AS STRING), 2, '0'), '-11T00:00:00Z')
                 WHEN 4 THEN '2026-07-10 09:30:00Z' WHEN 5 THEN '2026-07-10t09:30:00.123456z'
                 WHEN 6 THEN '2026-07-10T24:00:00Z' WHEN 7 THEN '2026-07-10T09:30:60Z' WHEN 8 THEN '2026-04-31T09:30:00Z'
                 WHEN 9 THEN '2026-07-10T09:30:00+24:00' WHEN 10 THEN '2026-07-10T01:30:00-05:30'
                 WHEN 11 THEN concat('2026-07-10T', lpad(CAST(c_custkey % 30 AS STRING), 2, '0'), ':15')
                 WHEN 12 THEN '1900-02-29T00:00:00Z' WHEN 13 THEN '2000-02-29T23:59:59.9Z' WHEN 14 THEN 'tomorrow'
                 WHEN 15 THEN '2026-07-10T09:30:00' WHEN 16 THEN '2026-02-30T09:30:05' ELSE NULL END AS deadline
        FROM {customer}""",
    ),
    "uploads": (
        ("orders",),
        """
        SELECT CAST(o_orderkey AS BIGINT) AS upload_id,
               CASE o_orderkey % 9 WHEN 0 THEN concat('C:', chr(92), 'docs', chr(92), 'file-', CAST(o_orderkey AS STRING), '.PDF')
                 WHEN 1 THEN concat('/srv/in/', CAST(o_orderkey AS STRING), '.docx') WHEN 2 THEN concat(' notes ', CAST(o_orderkey AS STRING), '.Txt ')
                 WHEN 3 THEN concat('tool-', CAST(o_orderkey AS STRING), '.exe') WHEN 4 THEN '.pdf' WHEN 5 THEN '   '
                 WHEN 6 THEN concat(repeat('n', 252), '.txt') WHEN 7 THEN concat('dir/', CAST(o_orderkey AS STRING), '.pdf/')
                 ELSE concat('a.b.', CAST(o_orderkey AS STRING), '.pdf') END AS raw_name,
               CASE WHEN o_orderkey % 10 = 3 THEN 0 ELSE (o_orderkey * 7919) % 31457280 END AS size_bytes,
               upper(substr(md5(CAST(o_orderkey AS STRING)), 1, CASE WHEN o_orderkey % 12 = 1 THEN 25 ELSE 26 END)) AS base_id,
               CASE o_orderkey % 6 WHEN 0 THEN 'I' WHEN 1 THEN 'L' WHEN 2 THEN 'z' ELSE 'Z' END AS id_tail,
               CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'tenant 1' WHEN 2 THEN repeat('t', 65) WHEN 3 THEN 'Ten_ant-9'
                    WHEN 4 THEN '租户' ELSE concat('t', CAST(o_custkey % 25 AS STRING)) END AS tenant_id,
               concat('P', CAST(o_custkey AS STRING)) AS project_id, o_orderdate AS uploaded_at,
               concat(md5(CAST(o_orderkey AS STRING)), md5(CAST(o_custkey AS STRING))) AS sha256,
               CASE o_orderkey % 11 WHEN 4 THEN 'parsed' ELSE 'queued' END AS parse_status, o_orderkey % 13 AS attempt
        FROM {orders}""",
    ),
    "outbox": (
        ("line_keys",),
        """
        SELECT concat('O', substr(line_key, 1, 25)) AS id, concat('t', CAST(o_custkey % 25 AS STRING)) AS tenant_id,
               concat('T', substr(line_key, 1, 25)) AS task_id, quantity % 7 AS publish_attempts,
               l_shipdate + CAST(l_suppkey % 90 AS INT) * INTERVAL '1' HOUR AS available_at, l_shipdate AS created_at,
               CASE WHEN l_partkey % 3 = 0 THEN l_shipdate + INTERVAL '1' DAY END AS published_at,
               CASE WHEN l_partkey % 3 = 1 AND l_suppkey % 2 = 0 THEN 'relay-a' WHEN l_partkey % 33 = 0 THEN 'relay-b' END AS lease_owner,
               CASE WHEN l_partkey % 3 = 1 AND l_suppkey % 2 = 0 THEN l_shipdate + CAST(quantity AS INT) * INTERVAL '10' DAY
                    WHEN l_partkey % 33 = 0 THEN l_shipdate END AS lease_expires_at,
               l_suppkey % 6 = 1 AS publish_fails
        FROM {line_keys}""",
    ),
}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a derived one built from its SQL."""
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    inputs, text = SHARED[name]
    return spark.sql(text, **{n: derive(spark, sf_dir, n) for n in inputs})


def tender_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per 24 consecutive part keys: its lines joined in key order.

    Some documents use CRLF and some carry a decomposed accent, so canonicalisation has work.
    """
    joined = (
        derive(spark, sf_dir, "tender_lines")
        .groupBy("doc_no")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("rows"))
    )
    accent = F.when(F.col("doc_no") % 3 == 0, F.lit("Cafe\u0301 annex")).otherwise(F.lit("annex"))
    lines = F.concat(F.transform("rows", lambda r: r["line"]), F.array(accent))
    newline = F.when(F.col("doc_no") % 5 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    return joined.select("doc_no", F.call_function("array_join", lines, newline).alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text documents: the provided prose plus the derived tenders, as ``(doc_id, text)``."""
    prose = table(spark, sf_dir, "documents").select("doc_id", "text").select(
        F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("doc_id"), "text"
    )
    tenders = tender_text(spark, sf_dir).select(
        F.concat(F.lit("t-"), F.col("doc_no").cast("string")).alias("doc_id"), "text"
    )
    return reduce(DataFrame.unionByName, (prose, tenders))
