"""Sentences → candidates → de-duplicated, coded, classified requirements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clauseloom.functions import fixed_values as fv
from clauseloom.functions.signals import (
    category_of,
    confidence_of,
    has_hard,
    has_score,
    may_signal,
    priority_of,
)
from clauseloom.functions.text import needs_nfc
from clauseloom.operators import layout, wordproc
from clauseloom.operators.blocks import canonical_documents, sectioned_blocks
from clauseloom.operators.sentences import split_sentences


def candidates(blocks: DataFrame, text: str = "line") -> DataFrame:
    """Sentences of non-heading blocks that carry a hard or a scoring signal.

    Blocks that cannot signal are dropped before they are split.
    """
    possible = blocks.filter((F.col("kind") != "heading") & may_signal(F.col(text)))
    tagged = (
        split_sentences(possible, text)
        .withColumn("hard", has_hard(F.col("quote")))
        .withColumn("score", has_score(F.col("quote")))
    )
    return tagged.filter(F.col("hard") | F.col("score"))


def keep_first_quote(found: DataFrame) -> DataFrame:
    """The earliest occurrence of each exact quote inside its own document."""
    rank = W.partitionBy("doc_id", "quote").orderBy("quote_start", "quote_end")
    return (
        found.withColumn("occurrence", F.row_number().over(rank))
        .filter("occurrence = 1")
        .drop("occurrence")
    )


def with_codes(found: DataFrame) -> DataFrame:
    """``code`` = REQ-0001… in document order; numbers past 9999 simply grow wider."""
    order = W.partitionBy("doc_id").orderBy("quote_start", "quote_end")
    return found.withColumn("ordinal", F.row_number().over(order)).withColumn(
        "code", F.format_string("REQ-%04d", "ordinal")
    )


def classify(found: DataFrame) -> DataFrame:
    return (
        found.withColumn("category", category_of(F.col("section_path"), F.col("quote")))
        .withColumn("priority", priority_of(F.col("hard")))
        .withColumn("confidence", confidence_of(F.col("hard"), F.col("score")))
    )


def extract_txt_requirements(docs: DataFrame) -> DataFrame:
    """Requirements of raw ``docs(doc_id, text)``.

    Everything up to the tagged sentence is narrow: documents that cannot signal are dropped at the
    scan, the rest are split in-row. Only candidate sentences are shuffled, once, by document;
    first-quote and codes share that layout.
    """
    text = F.col("text")
    # Text that NFC may change is kept untested: the signal could appear only afterwards.
    possible = docs.filter(may_signal(text) | needs_nfc(text))
    found = candidates(sectioned_blocks(canonical_documents(possible)))
    return classify(with_codes(keep_first_quote(found.repartition("doc_id"))))


def extract_block_requirements(blocks: DataFrame, evidence: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """Requirements of ``blocks(doc_id, block_no, kind, text, text_start, section_path, ...)`` of any format; columns of
    a block stay with its requirements, or what ``evidence`` makes of them where the block lies, before anything is shuffled."""
    found = evidence(candidates(blocks, "text"))
    return classify(with_codes(keep_first_quote(found.repartition("doc_id"))))


def extract_docx_requirements(documents: DataFrame) -> DataFrame:
    """Requirements of ``read_docx`` rows with the paragraph they stand in and their character range there.

    A block is one paragraph behind its list marker, so the range is what the quote covers of the paragraph.
    """
    found = extract_block_requirements(wordproc.extract_blocks(documents))
    start = F.greatest("quote_start", "span_start") - F.col("span_start")
    return found.withColumn("range_start", start).withColumn("range_end", F.col("quote_end") - F.col("span_start"))


def extract_pdf_requirements(runs: DataFrame) -> DataFrame:
    """Requirements of positioned text runs with ``regions``: page and box of every span that a quote touches, each
    once, in reading order."""
    def regions(found: DataFrame) -> DataFrame:
        touched = F.filter(
            "spans", lambda s: (s["text_start"] < F.col("quote_end")) & (s["text_end"] > F.col("quote_start"))
        )
        boxes = F.array_distinct(F.transform(touched, lambda s: F.struct(F.col("page").alias("page"), s["region"].alias("box"))))
        return found.withColumn("regions", boxes).drop("spans")

    return extract_block_requirements(layout.extract_pages(runs), regions)


def fixture_rows(files: DataFrame) -> DataFrame:
    """Three fixed development rows per file, without confidence."""
    rows = F.array(
        *[
            F.struct(*[F.lit(v).alias(k) for k, v in zip(
                ("code", "title", "description", "category", "priority"), row, strict=True)])
            for row in fv.FIXTURE_ROWS
        ]
    )
    return files.select("*", F.inline(rows)).select(
        "*",
        F.lit(fv.FIXTURE_METHOD).alias("extraction_method"),
        F.lit(None).cast("decimal(5,4)").alias("confidence"),
        F.lit(fv.FIXTURE_SECTION).alias("section"),
    )


def route_tasks(tasks: DataFrame) -> DataFrame:
    """``parser`` = fixture | rules, NULL with a reject reason for an unknown task type."""
    kind = F.col("type")
    parser = F.when(kind == fv.FIXTURE_TASK_TYPE, "fixture").when(kind == fv.RULE_TASK_TYPE, "rules")
    return tasks.withColumn("parser", parser).withColumn(
        "reject_reason", F.when(parser.isNull(), "UNSUPPORTED_TASK_TYPE")
    )


def recall_report(labelled: DataFrame) -> DataFrame:
    """``labelled(label, hard, score)`` → per label: sentences, hits, recall."""
    hit = (
        F.when(F.col("label") == "hard", F.col("hard"))
        .when(F.col("label") == "score", F.col("score"))
        .otherwise(F.col("hard") | F.col("score"))
    )
    return labelled.groupBy("label").agg(
        F.count("*").alias("sentences"),
        F.count_if(hit).alias("hits"),
        F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"),
    )
