"""Word-processor documents made from the tender lines, one archive per document, inside Spark tasks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.sources.derived import derive
from clauseloom.sources.docx import WORD, WORD_2010

_NS = f'xmlns:w="{WORD[0]}" xmlns:w14="{WORD_2010}"'
STYLES = (
    f"<w:styles {_NS}>"
    '<w:style w:styleId="Base1"><w:name w:val="base"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style>'
    '<w:style w:styleId="H1"><w:name w:val="first"/><w:basedOn w:val="Base1"/></w:style>'
    '<w:style w:styleId="Named"><w:name w:val="Heading 2"/><w:basedOn w:val="Loop"/></w:style>'
    '<w:style w:styleId="Loop"><w:basedOn w:val="Named"/></w:style>'
    '<w:style w:styleId="ListR"><w:basedOn w:val="ListBase"/></w:style>'
    '<w:style w:styleId="ListBase"><w:pPr><w:numPr><w:numId w:val="2"/></w:numPr></w:pPr></w:style>'
    "</w:styles>"
)


def _lvl(level: int, start: int, fmt: str, text: str) -> str:
    return (
        f'<w:lvl w:ilvl="{level}"><w:start w:val="{start}"/><w:numFmt w:val="{fmt}"/>'
        f'<w:lvlText w:val="{text}"/></w:lvl>'
    )


NUMBERING = (
    f"<w:numbering {_NS}>"
    f'<w:abstractNum w:abstractNumId="7">{_lvl(0, 1, "decimal", "%1.")}{_lvl(1, 1, "lowerLetter", "%1.%2)")}</w:abstractNum>'
    f'<w:abstractNum w:abstractNumId="8">{_lvl(0, 1, "upperRoman", "(%1)")}</w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num>'
    '<w:num w:numId="2"><w:abstractNumId w:val="8"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="3"/></w:lvlOverride></w:num>'
    "</w:numbering>"
)


def _p(text: str, props: str = "", attributes: str = "") -> str:
    run = f'<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r>' if text else ""
    return f"<w:p{attributes}>{f'<w:pPr>{props}</w:pPr>' if props else ''}{run}</w:p>"


def _numbered(num: int, level: int) -> str:
    return f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>'


def _body(kind: int, seq: int, line: str) -> str:
    if kind == 0:
        return _p(line, '<w:pStyle w:val="H1"/>')
    if kind == 1:
        return _p(line, '<w:pStyle w:val="Named"/>')
    if kind in (2, 9):
        return _p(line, _numbered(1, 0))
    if kind == 3:
        return _p(line, _numbered(1, 1))
    if kind == 4:
        return _p(line, '<w:pStyle w:val="ListR"/>')
    if kind == 5:
        cells = "".join(f"<w:tc>{_p(t)}</w:tc>" for t in (line, f"cell {seq}"))
        return f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>"
    if kind == 6:
        return f"<w:p><w:r><w:t>{escape(line)}</w:t><w:tab/><w:t>x</w:t><w:br/></w:r></w:p>"
    if kind == 7:
        hidden = "<w:del><w:r><w:delText>gone must</w:delText></w:r></w:del><w:r><w:instrText>shall</w:instrText></w:r>"
        return f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r>{hidden}</w:p>"
    if kind == 8:
        return _p(line, _numbered(99, 0))
    if kind == 10:
        return _p(line, attributes=f' w14:paraId="{seq:08x}"')
    return f"<w:sdt><w:sdtContent>{_p(line, '<w:pStyle w:val=\"Named\"/><w:outlineLvl w:val=\"9\"/>')}</w:sdtContent></w:sdt>"


def _archive(rows) -> bytes:
    body = "".join(_body(r["kind"], r["seq"], r["line"]) for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f"<w:document {_NS}><w:body>{body}</w:body></w:document>")
        archive.writestr("word/styles.xml", STYLES)
        archive.writestr("word/numbering.xml", NUMBERING)
    return out.getvalue()


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "content": [_archive(rows) for rows in batch["rows"]]})


def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, content)``: 24 tender lines per document, as in ``derived.tender_text``."""
    lines = (
        derive(spark, sf_dir, "tender_lines")
        .groupBy(F.concat(F.lit("w-"), F.col("doc_no").cast("string")).alias("doc_id"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "line"))).alias("rows"))
    )
    return lines.mapInPandas(_build, "doc_id string, content binary")
