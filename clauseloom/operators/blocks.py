"""Plain text → physical-line blocks with UTF-16 offsets, headings and section paths.

A document is one row and stays one row until its blocks are exploded: offsets and heading stacks are worked out in the row, so text is never shuffled
or sorted. ``bigtext`` does the same for documents that are too large for a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.signals import txt_heading
from clauseloom.functions.spans import line_ranges, open_titles
from clauseloom.functions.text import canonicalize


def canonical_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """LF newlines and NFC in place of ``text``."""
    return docs.withColumn(text, canonicalize(F.col(text)))


def _numbered(found: Column, *more: tuple[str, Column]) -> Column:
    """Blocks with their numbers, and the elements of further arrays beside them."""
    return F.transform(found, lambda b, i: F.struct(
        (i + 1).cast("long").alias("block_no"), *[b[name].alias(name) for name in ("line_no", "line", "text_start", "text_end")],
        *[column[i].alias(name) for name, column in more],
    ))


def line_blocks(docs: DataFrame) -> DataFrame:
    """One row per non-empty physical line of ``docs(doc_id, text)``; blank lines only count."""
    return docs.select("doc_id", line_ranges("text").alias("found")).select("doc_id", F.inline(_numbered(F.col("found"))))


def sectioned_blocks(docs: DataFrame) -> DataFrame:
    """``line_blocks`` plus ``kind`` (heading | paragraph), ``level``, ``title``, ``section_path``."""
    found = docs.select("doc_id", line_ranges("text").alias("found"))
    headed = found.withColumn("headings", F.transform("found", lambda b: txt_heading(b["line"])))
    pathed = headed.withColumn("paths", open_titles("headings"))
    blocks = pathed.select("doc_id", F.inline(_numbered(F.col("found"), ("heading", F.col("headings")), ("section_path", F.col("paths")))))
    return blocks.select(
        "doc_id", "block_no", "line_no", "line", "text_start", "text_end",
        F.when(F.col("heading").isNotNull(), "heading").otherwise("paragraph").alias("kind"),
        F.col("heading.level").alias("level"), F.col("heading.title").alias("title"), "section_path",
    )


def rebuilt_text(blocks: DataFrame) -> DataFrame:
    """Block texts of a document joined by one LF, in block order."""
    return blocks.groupBy("doc_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("block_no", "line"))), lambda b: b["line"]
            ),
            "\n",
        ).alias("rebuilt")
    )
