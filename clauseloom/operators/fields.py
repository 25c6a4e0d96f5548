"""Fields of documents: what they say after known labels, and whether the documents of a project agree.

Lines that start with a label (``项目名称：...``, ``Bid deadline: ...``) are found in the scan; their values are brought to a canonical form by kind, so that
"2026年7月10日" and "July 10, 2026" are one value. Values are voted on by documents: what most documents of a project say is its
value, and every document that says otherwise is named with its line. Votes are counted before they are shuffled, so a project with very many
documents is a few rows per task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.values import canonical_value
from clauseloom.operators.blocks import line_blocks


class Label(NamedTuple):
    """A field, the kind of its values, and a pattern of the labels it stands behind."""

    field: str
    kind: str
    pattern: str


LABELS = (
    Label("project_name", "name", "项目名称|工程名称|project name"),
    Label("project_code", "code", "项目编号|招标编号|project (?:code|no|number)"),
    Label("tenderee", "name", "招标人|采购人|tenderee|purchaser"),
    Label("bid_deadline", "date", "投标截止(?:时间|日期)?|递交截止时间|(?:bid|submission) deadline"),
    Label("budget", "amount", "预算金额|最高限价|budget|price ceiling"),
    Label("duration", "duration", "工期|服务期限|duration"),
)


def _behind(labels: tuple[Label, ...], line: Column) -> Column:
    """struct<field,kind,raw> of a line that starts with a label and a colon; null for others."""
    found = F.lit(None)
    for label in reversed(labels):
        pattern = rf"(?iu)^[\s\d.、#*()（）一二三四五六七八九十-]*(?:{label.pattern})\s*[:：]\s*(.+?)\s*$"
        value = F.struct(F.lit(label.field).alias("field"), F.lit(label.kind).alias("kind"), F.regexp_extract(line, pattern, 1).alias("raw"))
        found = F.when(line.rlike(pattern), value).otherwise(found)
    return F.when(line.rlike("[:：]"), found)


def document_fields(docs: DataFrame, labels: tuple[Label, ...] = LABELS) -> DataFrame:
    """``docs(project columns, doc_id, text)`` → ``(project columns, doc_id, field, line_no, raw, value)``: every labelled value; ``value`` is null
    where the text behind a label has no value of the field's kind."""
    project = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = F.struct("doc_id", *project)
    lines = line_blocks(docs.select(whole.alias("doc_id"), "text")).select("doc_id", "line_no", _behind(labels, F.col("line")).alias("found"))
    rows = lines.filter("found IS NOT NULL").select("doc_id.*", "line_no", "found.*")
    return rows.withColumn("value", canonical_value("kind", "raw")).select(*project, "doc_id", "field", "line_no", "raw", "value")


def field_votes(fields: DataFrame, *project: str) -> DataFrame:
    """``(project, field, value, documents)``: how many documents say a value; a document votes once for each value that it says."""
    said = fields.filter("value IS NOT NULL").groupBy(*project, "field", "value", "doc_id").agg(F.lit(1).alias("one"))
    return said.groupBy(*project, "field", "value").agg(F.count("*").alias("documents"))


def field_consensus(fields: DataFrame, *project: str) -> DataFrame:
    """``(project, field, value, documents, versions)``: what most documents say (of equally many the least value) and how many values there are."""
    votes = field_votes(fields, *project)
    # Most documents first, then the least value: one partial aggregate, whatever the number of values.
    top = votes.groupBy(*project, "field").agg(F.max("documents").alias("documents"), F.count("*").alias("versions"))
    tied = votes.join(top, [*project, "field", "documents"])
    return tied.groupBy(*project, "field", "documents", "versions").agg(F.min("value").alias("value")).select(
        *project, "field", "value", "documents", "versions"
    )


def field_conflicts(fields: DataFrame, *project: str) -> DataFrame:
    """``(project, field, doc_id, line_no, raw, value, agreed, documents)``: every labelled value that differs from its project's, and every one that
    cannot be read, with what was agreed and by how many documents (null where no document says a value)."""
    agreed = field_consensus(fields, *project).withColumnRenamed("value", "agreed").drop("versions")
    joined = fields.join(agreed, [*project, "field"], "left")
    return joined.filter(F.col("value").isNull() | (F.col("value") != F.col("agreed"))).select(
        *project, "field", "doc_id", "line_no", "raw", "value", "agreed", "documents"
    )
