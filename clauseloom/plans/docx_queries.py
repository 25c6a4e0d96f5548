"""Word-processor structure over documents built from the tender lines."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from clauseloom.operators import requirements as rq
from clauseloom.operators import wordproc as wp
from clauseloom.plans.catalog import entry
from clauseloom.plans.oracle_parts import PARTS, u16
from clauseloom.sources.docx import read_docx
from clauseloom.sources.docx_samples import docx_files

# What the documents contain, told from the lines they were built from.
PARTS["word_paragraphs"] = (
    ("tender_lines",),
    """
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq, cell) - 1 AS BIGINT) AS paragraph_index, kind, cell, text,
           CASE kind WHEN 0 THEN 'H1' WHEN 1 THEN 'Named' WHEN 11 THEN 'Named' WHEN 4 THEN 'ListR' END AS style_id,
           CASE WHEN kind = 11 THEN 9 END::BIGINT AS outline_level,
           CASE WHEN kind IN (2, 3, 9) THEN '1' WHEN kind = 8 THEN '99' END AS num_id, CASE WHEN kind IN (2, 8, 9) THEN 0 WHEN kind = 3 THEN 1 END::BIGINT AS num_level,
           CASE WHEN kind = 10 THEN upper(lpad(printf('%x', seq), 8, '0')) END AS paragraph_id,
           CASE WHEN kind = 5 THEN CAST(count(*) FILTER (WHERE kind = 5 AND cell = 0) OVER (PARTITION BY doc_id ORDER BY seq, cell) - 1 AS VARCHAR) || '/0/' || cell ELSE '' END AS table_path,
           CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 END::BIGINT AS heading_level
    FROM (SELECT 'w-' || doc_no AS doc_id, seq, kind, 0 AS cell, CASE WHEN kind = 6 THEN line || chr(9) || 'x' || chr(10) ELSE line END AS text FROM tender_lines
          UNION ALL SELECT 'w-' || doc_no, seq, kind, 1, 'cell ' || seq FROM tender_lines WHERE kind = 5)""",
)
PARTS["word_marked"] = (
    ("word_paragraphs",),
    """
    SELECT *, CASE WHEN kind IN (2, 9) THEN c0 || '.' WHEN kind = 3 THEN c0 || '.' || chr(CAST(96 + c1 AS INT)) || ')'
                   WHEN kind = 4 THEN '(' || (['I', 'II', 'III', 'IV', 'V', 'VI'])[c4 + 2] || ')' END AS marker
    FROM (SELECT *, count(*) FILTER (WHERE kind = 4) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS c4,
                 count(*) FILTER (WHERE kind = 3) OVER (PARTITION BY doc_id, c0 ORDER BY paragraph_index) AS c1
          FROM (SELECT *, count(*) FILTER (WHERE kind IN (2, 9)) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS c0 FROM word_paragraphs))""",
)
PARTS["word_blocks"] = (
    ("word_marked",),
    f"""
    SELECT *, CAST(coalesce(sum({u16('shown')} + 1) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS text_start
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS block_no,
                 coalesce(marker || ' ', '') || text AS shown, count(*) FILTER (WHERE kind = 0) OVER (PARTITION BY doc_id ORDER BY paragraph_index) AS chapter FROM word_marked WHERE text <> '')""",
)


def documents(spark, sf_dir):
    return read_docx(docx_files(spark, sf_dir))


def _table_path():
    return F.array_join(
        F.transform("table_path", lambda t: F.concat_ws("/", t["table_index"], t["row_index"], t["cell_index"])), ">"
    ).alias("table_path")


@entry(
    "src_docx_paragraphs",
    ("word_paragraphs",),
    "SELECT doc_id, paragraph_index, paragraph_id, table_path, style_id, outline_level, num_id, num_level, text FROM word_paragraphs",
)
def src_docx_paragraphs(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.inline("paragraphs"))
    return rows.select(
        "doc_id", "paragraph_index", "paragraph_id", _table_path(), "style_id", "outline_level", "num_id", "num_level", "text"
    )


def styled(spark, sf_dir):
    return wp.with_inherited_styles(documents(spark, sf_dir))


@entry(
    "docx_style_chain",
    ("word_paragraphs",),
    """SELECT doc_id, paragraph_index, CASE kind WHEN 0 THEN 0 END::BIGINT AS inherited_outline, CASE WHEN kind IN (1, 11) THEN 2 END::BIGINT AS name_level,
              CASE kind WHEN 4 THEN '2' END AS inherited_list FROM word_paragraphs""",
)
def docx_style_chain(spark, sf_dir):
    return styled(spark, sf_dir).select(
        "doc_id", "paragraph_index", F.col("chain.outline").alias("inherited_outline"),
        F.col("chain.fallback").alias("name_level"), F.col("chain.num_id").alias("inherited_list"),
    )


@entry(
    "docx_heading_level",
    ("word_paragraphs",),
    "SELECT doc_id, paragraph_index, heading_level FROM word_paragraphs",
)
def docx_heading_level(spark, sf_dir):
    return wp.with_heading_level(styled(spark, sf_dir)).select("doc_id", "paragraph_index", "heading_level")


@entry(
    "docx_numbering_resolve",
    ("word_paragraphs",),
    """SELECT doc_id, paragraph_index, CASE WHEN kind = 4 THEN '2' ELSE num_id END AS list_id, CASE WHEN kind = 4 THEN 0 ELSE num_level END AS list_level,
              CASE WHEN kind IN (2, 3, 9) THEN 1 WHEN kind = 4 THEN 3 END::BIGINT AS start,
              CASE WHEN kind IN (2, 9) THEN 'decimal' WHEN kind = 3 THEN 'lowerLetter' WHEN kind = 4 THEN 'upperRoman' END AS format
       FROM word_paragraphs WHERE kind IN (2, 3, 4, 8, 9)""",
)
def docx_numbering_resolve(spark, sf_dir):
    listed = wp.with_numbering(styled(spark, sf_dir)).filter("list_id IS NOT NULL")
    level = F.try_element_at("levels", F.col("list_level"))
    return listed.select(
        "doc_id", "paragraph_index", "list_id", "list_level", level["start"].alias("start"), level["format"].alias("format")
    )


def marked(spark, sf_dir):
    listed = wp.with_numbering(wp.with_heading_level(styled(spark, sf_dir)))
    return wp.with_markers(wp.with_counters(listed))


@entry(
    "docx_numbering_counters",
    ("word_marked",),
    """SELECT doc_id, paragraph_index, CASE WHEN kind = 4 THEN c4 + 2 ELSE c0 END AS first_level, CASE WHEN kind = 3 THEN c1 END AS second_level
       FROM word_marked WHERE kind IN (2, 3, 4, 9)""",
)
def docx_numbering_counters(spark, sf_dir):
    return marked(spark, sf_dir).filter("counters IS NOT NULL").select(
        "doc_id", "paragraph_index", F.col("counters")[0].alias("first_level"), F.col("counters")[1].alias("second_level")
    )


@entry("docx_marker_format", ("word_marked",), "SELECT doc_id, paragraph_index, marker FROM word_marked")
def docx_marker_format(spark, sf_dir):
    return marked(spark, sf_dir).select("doc_id", "paragraph_index", "marker")


@entry(
    "docx_blocks",
    ("word_blocks",),
    f"""SELECT doc_id, block_no, CASE WHEN heading_level IS NOT NULL THEN 'heading' WHEN kind = 5 THEN 'table-cell' ELSE 'paragraph' END AS kind, shown AS text,
               text_start, text_start + {u16('shown')} AS text_end, text_start + length(coalesce(marker || ' ', '')) AS span_start, {u16('text')} AS char_end, paragraph_index,
               CASE WHEN heading_level = 1 THEN shown WHEN heading_level = 2 THEN coalesce(chapter_text || '|', '') || shown
                    ELSE array_to_string(list_filter([chapter_text, section_text], lambda x: x IS NOT NULL), '|') END AS section_path
        FROM (SELECT *, last_value(CASE WHEN kind = 0 THEN shown END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no) AS chapter_text,
                     last_value(CASE WHEN kind = 1 THEN shown END IGNORE NULLS) OVER (PARTITION BY doc_id, chapter ORDER BY block_no) AS section_text FROM word_blocks)""",
)
def docx_blocks(spark, sf_dir):
    return wp.extract_blocks(documents(spark, sf_dir)).select(
        "doc_id", "block_no", "kind", "text", "text_start", "text_end", "span_start", "char_end", "paragraph_index", "section_path"
    )


# The extraction of the text format, over these blocks.
PARTS["word_pathed"] = (
    ("word_blocks",),
    """
    SELECT doc_id, block_no, block_no AS line_no, shown AS line, text_start, CASE WHEN heading_level IS NOT NULL THEN 'heading' ELSE 'paragraph' END AS kind,
           list_filter([chapter_text, section_text], lambda x: x IS NOT NULL) AS path
    FROM (SELECT *, last_value(CASE WHEN kind = 0 THEN shown END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no) AS chapter_text,
                 last_value(CASE WHEN kind = 1 THEN shown END IGNORE NULLS) OVER (PARTITION BY doc_id, chapter ORDER BY block_no) AS section_text FROM word_blocks)""",
)
_CHAIN = ("pathed", "pieces", "sentences", "tagged", "candidates", "firsts", "extracted")
for _before, _name in zip(_CHAIN, _CHAIN[1:], strict=False):
    PARTS[f"word_{_name}"] = ((f"word_{_before}",), re.sub(rf"\bFROM {_before}\b", f"FROM word_{_before}", PARTS[_name][1]))


@entry(
    "req_extract_docx",
    ("word_extracted", "word_blocks"),
    """SELECT doc_id, code, quote, category, priority, confidence, array_to_string(path, '|') AS section_path, quote_start, quote_end, sha256(quote) AS quote_sha256,
              paragraph_index, paragraph_id, table_path, greatest(quote_start, span_start) - span_start AS range_start, quote_end - span_start AS range_end
       FROM word_extracted JOIN (SELECT doc_id, block_no, paragraph_index, paragraph_id, table_path, text_start + length(coalesce(marker || ' ', '')) AS span_start FROM word_blocks) USING (doc_id, block_no)""",
)
def req_extract_docx(spark, sf_dir):
    return rq.extract_docx_requirements(documents(spark, sf_dir)).select(
        "doc_id", "code", "quote", "category", "priority", "confidence", "section_path", "quote_start", "quote_end",
        F.sha2("quote", 256).alias("quote_sha256"), "paragraph_index", "paragraph_id", _table_path(), "range_start", "range_end",
    )


@entry(
    "docx_rejects",
    ("tender_lines",),
    """SELECT 'w-' || doc_no AS doc_id, 'INVALID_DOCX' AS reject_reason FROM (SELECT DISTINCT doc_no FROM tender_lines) WHERE doc_no % 4 <> 0""",
)
def docx_rejects(spark, sf_dir):
    # Three documents in four are broken: cut short, without a body, not an archive.
    number = F.substring_index("doc_id", "-", -1).cast("long") % 4
    content = F.col("content")
    broken = (
        F.when(number == 1, F.expr("substring(content, 1, octet_length(content) div 2)"))
        .when(number == 2, F.encode(F.lit("no archive"), "UTF-8")).when(number == 3, F.expr("X''")).otherwise(content)
    )
    return wp.rejected(read_docx(docx_files(spark, sf_dir).withColumn("content", broken)))
