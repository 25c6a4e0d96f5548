"""Positions, overlaps and locator validation over the corpus."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv
from clauseloom.operators import blocks as bl
from clauseloom.operators import locators as lc
from clauseloom.operators import requirements as rq
from clauseloom.plans.catalog import entry
from clauseloom.plans.oracle_parts import u16
from clauseloom.plans.quality_queries import _FLAT
from clauseloom.plans.text_queries import canonical
from clauseloom.sources.derived import corpus, derive


def extracted(spark, sf_dir):
    return rq.extract_txt_requirements(corpus(spark, sf_dir))


@entry(
    "pos_at_offset",
    ("sentences", "all_lines"),
    """SELECT o.doc_id, o."offset", l.line_no AS line, o."offset" - l.text_start AS "column" FROM (
         SELECT doc_id, quote_start AS "offset" FROM sentences UNION ALL SELECT doc_id, quote_end FROM sentences) o
       JOIN all_lines l ON l.doc_id = o.doc_id AND o."offset" BETWEEN l.text_start AND l.text_start + l.n""",
)
def pos_at_offset(spark, sf_dir):
    from clauseloom.plans.text_queries import sentences

    docs = canonical(spark, sf_dir)
    ranges = sentences(spark, sf_dir)
    ends = ranges.select("doc_id", F.explode(F.array("quote_start", "quote_end")).alias("offset"))
    return lc.positions_at(docs, ends)


@entry(
    "pos_advance",
    ("canon",),
    f"""SELECT doc_id, 3 + length(text) - length(replace(text, chr(10), '')) AS line,
               CASE WHEN contains(text, chr(10)) THEN 0 ELSE 5 END + {u16("string_split(text, chr(10))[-1]")} AS "column" FROM canon""",
)
def pos_advance(spark, sf_dir):
    three, five = F.lit(3).cast("long"), F.lit(5).cast("long")
    line, column = lc.advance(three, five, F.col("text"))
    return canonical(spark, sf_dir).select("doc_id", line.alias("line"), column.alias("column"))


@entry(
    "loc_txt",
    ("extracted", "line_blocks"),
    """SELECT e.doc_id, e.code, e.line_no AS start_line, e.quote_start - b.text_start AS start_column, e.line_no AS end_line,
              e.quote_end - b.text_start AS end_column FROM extracted e JOIN line_blocks b ON b.doc_id = e.doc_id AND b.block_no = e.block_no""",
)
def loc_txt(spark, sf_dir):
    return lc.txt_positions(extracted(spark, sf_dir))


# Spans of a block: runs of ten units every twelve, so some text lies between spans.
_SPAN_SQL = """
    SELECT doc_id, block_no, CAST(i AS BIGINT) AS span_no, text_start + i * 12 AS span_start, least(text_start + i * 12 + 10, text_end) AS span_end,
           line_no % 9 + 1 AS page, CAST(i % 3 AS BIGINT) AS cell
    FROM (SELECT *, unnest(range(0, (text_end - text_start + 11) // 12)) AS i FROM line_blocks)"""


def spans_of(spark, sf_dir):
    blocks = bl.line_blocks(canonical(spark, sf_dir)).select("doc_id", "block_no", "line_no", "text_start", "text_end")
    parts = lc.quoted_parts(quotes_of(spark, sf_dir), blocks, reach=10)
    # Spans that start in the part; a part may be too short for any.
    first, last = (F.ceil((F.col(c) - F.col("text_start")) / 12) for c in ("part_start", "part_end"))
    rows = parts.select("*", F.explode(F.when(first < last, F.sequence(first, last - 1))).alias("span_no"))
    start = F.col("text_start") + F.col("span_no") * 12
    return rows.select(
        "doc_id", "block_no", "span_no", start.alias("span_start"),
        F.least(start + 10, "text_end").alias("span_end"),
        (F.col("line_no") % 9 + 1).alias("page"), (F.col("span_no") % 3).alias("cell"),
    )


def quotes_of(spark, sf_dir):
    return extracted(spark, sf_dir).select("doc_id", "block_no", "quote_start", "quote_end")


_OVERLAP = f"""
    SELECT e.doc_id, e.quote_start, e.quote_end, s.span_no, s.span_start, s.span_end, s.page, s.cell
    FROM extracted e JOIN ({_SPAN_SQL}) s ON s.doc_id = e.doc_id AND s.block_no = e.block_no
     AND s.span_start < e.quote_end AND s.span_end > e.quote_start"""


@entry(
    "loc_span_overlap",
    ("extracted", "line_blocks"),
    f"SELECT doc_id, quote_start, quote_end, min(span_no) AS first_span FROM ({_OVERLAP}) GROUP BY ALL",
)
def loc_span_overlap(spark, sf_dir):
    return lc.first_spans(quotes_of(spark, sf_dir), spans_of(spark, sf_dir))


@entry(
    "loc_pdf",
    ("extracted", "line_blocks"),
    f"""SELECT doc_id, quote_start, quote_end, row_number() OVER (PARTITION BY doc_id, quote_start ORDER BY first_span) AS region_no, page,
               cell / 10 AS x, 0.25::DOUBLE AS y, 0.1::DOUBLE AS width, 0.02::DOUBLE AS height
        FROM (SELECT doc_id, quote_start, quote_end, page, cell, min(span_no) AS first_span FROM ({_OVERLAP}) GROUP BY ALL)""",
)
def loc_pdf(spark, sf_dir):
    spans = spans_of(spark, sf_dir).withColumns(
        {
            "x": F.col("cell") / 10, "y": F.lit(0.25), "width": F.lit(0.1), "height": F.lit(0.02),
        }
    )
    return lc.page_regions(quotes_of(spark, sf_dir), spans)


@entry(
    "loc_docx",
    ("extracted", "line_blocks"),
    f"""SELECT doc_id, quote_start, quote_end, row_number() OVER (PARTITION BY doc_id, quote_start ORDER BY span_no) AS range_no,
               CASE WHEN span_no % 2 = 0 THEN 'A' || cell END AS paragraph_id, page AS paragraph_index, 'T' || cell AS table_path,
               span_no * 100 + greatest(quote_start, span_start) - span_start AS range_start, span_no * 100 + least(quote_end, span_end) - span_start AS range_end
        FROM ({_OVERLAP})""",
)
def loc_docx(spark, sf_dir):
    spans = spans_of(spark, sf_dir).withColumns(
        {
            "char_start": F.col("span_no") * 100,
            "paragraph_id": F.when(F.col("span_no") % 2 == 0, F.concat(F.lit("A"), "cell")),
            "paragraph_index": F.col("page"),
            "table_path": F.concat(F.lit("T"), "cell"),
        }
    )
    return lc.paragraph_ranges(quotes_of(spark, sf_dir), spans)


# Locators of the extraction, with a defect planted by requirement number.
_LOCATORS = """
    SELECT e.doc_id, e.code, CASE WHEN ordinal % 13 = 1 THEN 2 ELSE 1 END AS version,
           'doc' || CASE WHEN ordinal % 13 = 2 THEN '.pdf' ELSE '.TXT' END AS file_name,
           CASE WHEN ordinal % 13 = 3 THEN upper(sha256(e.doc_id)) ELSE sha256(e.doc_id) END AS source_sha256,
           quote, CASE WHEN ordinal % 13 = 4 THEN sha256('x') ELSE sha256(quote) END AS quote_sha256,
           quote_start + CASE WHEN ordinal % 13 = 6 THEN 1 ELSE 0 END AS text_start,
           quote_end + CASE WHEN ordinal % 13 IN (5, 6) THEN 1 ELSE 0 END AS text_end,
           e.line_no + CASE WHEN ordinal % 13 = 7 THEN 1 ELSE 0 END AS start_line, quote_start - b.text_start AS start_column,
           e.line_no + CASE WHEN ordinal % 13 = 9 THEN 1 ELSE 0 END AS end_line,
           quote_end - b.text_start + CASE WHEN ordinal % 13 = 8 THEN 1 ELSE 0 END AS end_column, path
    FROM extracted e JOIN line_blocks b ON b.doc_id = e.doc_id AND b.block_no = e.block_no"""


def planted_locators(spark, sf_dir):
    n = F.col("ordinal") % 13

    def plus(name, *defects):
        return F.col(name) + F.when(n.isin(*defects), 1).otherwise(0)

    digest = F.sha2("doc_id", 256)
    return extracted(spark, sf_dir).select(
        "doc_id", "code", "ordinal", "section_path", "quote", "line_no",
        F.when(n == 1, 2).otherwise(1).alias("version"),
        F.concat(F.lit("doc"), F.when(n == 2, ".pdf").otherwise(".TXT")).alias("file_name"),
        F.when(n == 3, F.upper(digest)).otherwise(digest).alias("source_sha256"),
        F.when(n == 4, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("quote", 256)).alias("quote_sha256"),
        plus("line_no", 7).alias("start_line"), plus("line_no", 9).alias("end_line"),
        (F.col("quote_start") - F.col("text_start")).alias("start_column"),
        (F.col("quote_end") - F.col("text_start") + F.when(n == 8, 1).otherwise(0)).alias("end_column"),
        plus("quote_start", 6).alias("text_start"), plus("quote_end", 5, 6).alias("text_end"),
    )


@entry(
    "loc_validate",
    ("extracted", "line_blocks", "canon", "all_lines"),
    f"""SELECT l.doc_id, l.code, CASE WHEN version <> 1 THEN 'VERSION' WHEN NOT regexp_matches(source_sha256, '^[0-9a-f]{{64}}$') THEN 'SOURCE_HASH'
               WHEN quote_sha256 <> sha256(quote) THEN 'QUOTE_HASH' WHEN text_end - text_start <> {u16('quote')} THEN 'OFFSETS'
               WHEN substr(flat, text_start + 1, text_end - text_start) <> {_FLAT.format('quote')} THEN 'SLICE'
               WHEN lower(file_name) NOT LIKE '%.txt' THEN 'FILE_KIND'
               WHEN NOT (start_line < end_line OR (start_line = end_line AND start_column < end_column)) THEN 'ORDER'
               WHEN end_line <> start_line OR end_column <> start_column + {u16('quote')} THEN 'QUOTE_LENGTH'
               WHEN NOT EXISTS (SELECT 1 FROM all_lines a WHERE a.doc_id = l.doc_id AND a.line_no = start_line AND a.text_start + start_column = l.text_start) THEN 'POSITION' END AS reason
        FROM ({_LOCATORS}) l JOIN (SELECT doc_id, {_FLAT.format('text')} AS flat FROM canon) c ON c.doc_id = l.doc_id""",
)
def loc_validate(spark, sf_dir):
    return lc.validate_txt_locators(canonical(spark, sf_dir), planted_locators(spark, sf_dir))


# Locators of every kind with defects planted by line, page and column; the structs are built from these columns.
_STATED = """
    SELECT id, kind, CASE WHEN n = 1 THEN 2 ELSE 1 END AS version, CASE WHEN n = 2 THEN 'x' ELSE source_sha256 END AS source_sha256, quote, quote_sha256,
           text_start, CASE WHEN n = 3 THEN text_end + 1 ELSE text_end END AS text_end, file_name, media_type, n, page, line, column_no,
           CASE WHEN n = 4 THEN 3 END AS page_number, CASE WHEN n = 5 THEN 1 END AS fixture_index
    FROM (SELECT id, kind, page, line, column_no, n, source_sha256, quote, CASE WHEN n = 6 THEN sha256_of('other') ELSE sha256_of(quote) END AS quote_sha256, column_no AS text_start,
                 column_no + units_of(quote) AS text_end,
                 concat('file', CASE WHEN n = 7 THEN '.bin' WHEN kind = 'pdf' THEN '.PDF' WHEN kind = 'docx' THEN '.docx' ELSE '.txt' END) AS file_name,
                 CASE WHEN n = 8 THEN 'text/html' WHEN kind = 'pdf' THEN 'application/pdf' WHEN kind = 'txt' THEN 'Text/Plain ; charset=utf-8' END AS media_type
          FROM (SELECT id, kind, page, line, column_no, (page * 7 + line * 3 + column_no) % 17 AS n, sha256_of(id) AS source_sha256,
                       CASE (page * 7 + line * 3 + column_no) % 17 WHEN 9 THEN '' WHEN 10 THEN concat('a', unit_13, 'b') WHEN 11 THEN 'é' WHEN 12 THEN 'q 😀 z' ELSE concat('must ', title) END AS quote
                FROM {requirements}))"""


def _stated(dialect: dict[str, str], requirements: str) -> str:
    text = _STATED.format(requirements=requirements)
    for name, form in dialect.items():
        text = re.sub(rf"{name}(?:\(([^()]*)\))?", lambda m, form=form: form.replace("{0}", m[1] or ""), text)
    return text


_STATED_SPARK = {"sha256_of": "sha2({0}, 256)", "units_of": "CAST(octet_length(encode({0}, 'UTF-16BE')) / 2 AS BIGINT)", "unit_13": "char(13)"}
_STATED_DUCKDB = {"sha256_of": "sha256({0})", "units_of": u16("{0}"), "unit_13": "chr(13)"}


@entry(
    "loc_validate_kinds",
    ("requirements",),
    f"""SELECT id, kind, CASE WHEN kind NOT IN ('pdf', 'docx', 'txt', 'development-fixture') THEN 'KIND' WHEN kind = 'development-fixture' THEN
                 CASE WHEN quote = '' THEN 'QUOTE_EMPTY' WHEN page_number IS NOT NULL OR fixture_index IS NOT NULL THEN 'FIXTURE' END
               WHEN version <> 1 THEN 'VERSION' WHEN NOT regexp_matches(source_sha256, '^[0-9a-f]{{64}}$') THEN 'SOURCE_HASH' WHEN quote = '' THEN 'QUOTE_EMPTY'
               WHEN n IN (10, 11) THEN 'NOT_CANONICAL' WHEN quote_sha256 <> sha256(quote) THEN 'QUOTE_HASH' WHEN n = 3 THEN 'OFFSETS'
               WHEN n = 7 THEN 'FILE_KIND' WHEN n = 8 THEN 'MEDIA_TYPE'
               WHEN kind = 'pdf' AND (n = 13 OR page < 1 OR line / 10::DOUBLE + column_no / 60::DOUBLE > 1 OR column_no <= 0) THEN 'REGIONS'
               WHEN kind = 'docx' AND (n = 13 OR n = 14 OR n = 15 OR column_no < 0) THEN 'RANGES' END AS reason
        FROM ({_stated(_STATED_DUCKDB, 'requirements')})""",
)
def loc_validate_kinds(spark, sf_dir):
    rows = spark.sql(_stated(_STATED_SPARK, "{requirements}"), requirements=derive(spark, sf_dir, "requirements"))
    n, column = F.col("n"), F.col("column_no")
    box = F.struct(
        "page", (F.col("line") / 10).alias("x"), (F.col("line") / 10).alias("y"), (column / 60).alias("width"), (column / 60).alias("height")
    )
    part = F.struct(
        F.when(n == 14, "").when(F.col("page") % 2 == 0, F.lit("0A1B2C3D")).alias("paragraph_id"), F.col("line").alias("paragraph_index"),
        F.array(F.lit(0), F.when(n == 15, -1).otherwise(1)).alias("table_path"), column.alias("char_start"), (column + 4).alias("char_end"),
    )
    none = F.when(n == 13, 0).otherwise(1)
    return lc.locator_reasons(
        rows.withColumn("regions", F.slice(F.array(box), F.lit(1), none)).withColumn("ranges", F.slice(F.array(part), F.lit(1), none))
    )


_KEYS = {kind: "[" + ", ".join(f"'{n}'" for n in names) + "]" for kind, names in fv.LOCATOR_KEYS.items()}
_KEYED = """
    SELECT id, kind, concat('{{"kind":"', kind, '"', CASE WHEN kind = 'development-fixture'
             THEN concat(',"fileId":1,"fileName":2,"pageNumber":null,"sectionPath":[],"quote":"q"', CASE WHEN page % 4 = 1 THEN '' ELSE ',"paragraphIndex":null' END)
             ELSE concat(',"version":1,"sourceFileId":1,"sourceFileName":2,"sourceRevision":1,"sourceSha256":"s","quote":"q","quoteSha256":"h","textStart":0,"sectionPath":[],"parserVersion":"v"',
                         CASE WHEN page % 5 = 2 THEN '' ELSE ',"textEnd":9' END,
                         CASE kind WHEN 'pdf' THEN ',"regions":[]' WHEN 'docx' THEN ',"ranges":[]' ELSE ',"start":{{}},"end":{{}}' END) END,
             CASE WHEN page % 7 = 3 THEN ',"extra":true' ELSE '' END, '}}') AS locator
    FROM {requirements}"""


@entry(
    "loc_exact_keys",
    ("requirements",),
    f"""SELECT id, kind, array_to_string(list_sort(list_filter(wanted, lambda k: NOT list_contains(have, k))), '|') AS missing,
               array_to_string(list_sort(list_filter(have, lambda k: NOT list_contains(wanted, k))), '|') AS unknown
        FROM (SELECT id, kind, json_keys(locator) AS have, CASE kind WHEN 'pdf' THEN {_KEYS['pdf']} WHEN 'docx' THEN {_KEYS['docx']} WHEN 'txt' THEN {_KEYS['txt']}
                     ELSE {_KEYS['development-fixture']} END AS wanted FROM ({_KEYED.format(requirements='requirements')}))""",
)
def loc_exact_keys(spark, sf_dir):
    return lc.key_differences(spark.sql(_KEYED, requirements=derive(spark, sf_dir, "requirements")))


_EVIDENCE = """
    SELECT r.id, r.extraction_method, r.kind, t.type AS task_type, CAST(r.confidence AS DOUBLE) + CASE WHEN r.page = 5 THEN CAST(0.00001 AS DOUBLE) WHEN r.page = 6 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence
    FROM {requirements} r JOIN {parse_tasks} t ON t.tenant_id = r.tenant_id AND t.id = r.task_id"""


@entry(
    "loc_evidence_consistency",
    ("requirements", "parse_tasks"),
    f"""SELECT id, extraction_method, kind, task_type, CASE
          WHEN extraction_method = 'development-fixture' AND (kind <> 'development-fixture' OR confidence IS NOT NULL OR task_type <> 'development-document-parse') THEN 'FIXTURE_INCONSISTENT'
          WHEN extraction_method NOT IN ('development-fixture', 'deterministic-rules-v1') THEN 'METHOD'
          WHEN extraction_method = 'deterministic-rules-v1' AND (kind = 'development-fixture' OR task_type <> 'document-parse-v1') THEN 'RULES_INCONSISTENT'
          WHEN extraction_method = 'deterministic-rules-v1' AND (confidence IS NULL OR confidence < 0 OR confidence > 1) THEN 'CONFIDENCE_RANGE'
          WHEN extraction_method = 'deterministic-rules-v1' AND round(confidence, 4) <> confidence THEN 'CONFIDENCE_DECIMALS' END AS reason
        FROM ({_EVIDENCE.format(requirements='requirements', parse_tasks='parse_tasks')})""",
)
def loc_evidence_consistency(spark, sf_dir):
    rows = spark.sql(_EVIDENCE, **{n: derive(spark, sf_dir, n) for n in ("requirements", "parse_tasks")})
    return rows.select("id", "extraction_method", "kind", "task_type", lc.evidence_reason().alias("reason"))


_NEW_TEXT = "CASE WHEN doc_id LIKE 't-%' AND length(text) % 2 = 0 THEN concat('Preface', chr(10), replace(text, '证书', '文件')) ELSE text END"


@entry(
    "chk_relocate_quote",
    ("extracted", "canon"),
    f"""SELECT e.doc_id, e.code, CASE WHEN substr(c.flat, quote_start + 1, quote_end - quote_start) = {_FLAT.format('quote')} THEN 'exact'
               WHEN contains(c.text, quote) THEN 'relocated' ELSE 'lost' END AS outcome
        FROM extracted e JOIN (SELECT doc_id, text, {_FLAT.format('text')} AS flat FROM (SELECT doc_id, {_NEW_TEXT} AS text FROM canon)) c ON c.doc_id = e.doc_id""",
)
def chk_relocate_quote(spark, sf_dir):
    newer = canonical(spark, sf_dir).withColumn("text", F.expr(_NEW_TEXT))
    located = extracted(spark, sf_dir).select(
        "doc_id", "code", "quote", F.col("quote_start").alias("text_start"), F.col("quote_end").alias("text_end")
    )
    return lc.relocate_quotes(newer, located)


@entry(
    "chk_requirement_diff",
    ("extracted", "canon"),
    f"""SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.quote, n.quote) AS quote,
               CASE WHEN n.quote IS NULL THEN 'removed' WHEN o.quote IS NULL THEN 'added' ELSE 'kept' END AS change,
               CASE WHEN n.quote IS NOT NULL AND o.ordinal IS NOT NULL THEN CASE WHEN o.ordinal % 2 = 0 THEN 'confirmed' ELSE 'pending' END END AS decision
        FROM extracted o FULL JOIN (
          SELECT doc_id, quote FROM (SELECT e.doc_id, CASE WHEN c.changed THEN replace(e.quote, '证书', '文件') ELSE e.quote END AS quote
             FROM extracted e JOIN (SELECT doc_id, doc_id LIKE 't-%' AND length(text) % 2 = 0 AS changed FROM canon) c ON c.doc_id = e.doc_id)) n
        ON n.doc_id = o.doc_id AND n.quote = o.quote""",
)
def chk_requirement_diff(spark, sf_dir):
    newer = canonical(spark, sf_dir).withColumn("text", F.expr(_NEW_TEXT))
    old = extracted(spark, sf_dir).select(
        "doc_id", "quote", F.when(F.col("ordinal") % 2 == 0, "confirmed").otherwise("pending").alias("was")
    )
    new = rq.extract_txt_requirements(newer).select("doc_id", "quote", F.lit(True).alias("present"))
    both = old.join(new, ["doc_id", "quote"], "full")
    return both.select(
        "doc_id", "quote",
        F.when(F.col("present").isNull(), "removed").when(F.col("was").isNull(), "added").otherwise("kept").alias("change"),
        F.when(F.col("present").isNotNull(), F.col("was")).alias("decision"),
    )
