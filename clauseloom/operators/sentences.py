"""Blocks → trimmed sentence ranges with absolute UTF-16 offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.spans import sentence_pieces, sentence_quotes


def raw_pieces(blocks: DataFrame, text: str = "line") -> DataFrame:
    """Every piece between sentence breaks, untrimmed, with its offset inside the block."""
    return blocks.select(*blocks.columns, F.inline(sentence_pieces(text)))


def split_sentences(blocks: DataFrame, text: str = "line", start: str = "text_start") -> DataFrame:
    """One row per non-blank sentence: edges trimmed, offsets shifted, inner text untouched."""
    rows = blocks.select(*blocks.columns, F.inline(sentence_quotes(text)))
    return (
        rows.withColumn("quote_start", F.col(start) + F.col("lead"))
        .withColumn("quote_end", F.col(start) + F.col("lead") + F.col("units"))
        .drop("lead", "units")
    )
