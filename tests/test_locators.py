"""Spans are made only where a quote can meet them, and none of these is missed."""

from pyspark.sql import functions as F

from clauseloom.operators import locators
from clauseloom.plans import locator_queries

REACH = 10


def test_parts_of_blocks_miss_no_span(spark):
    blocks = spark.createDataFrame(
        [("a", 1, 0, 5000), ("a", 2, 5001, 5004), ("b", 1, 7, 90_000), ("c", 1, 0, 3000)],
        "doc_id string, block_no long, text_start long, text_end long",
    )
    quotes = spark.createDataFrame(
        [("a", 1, 1020, 1030), ("a", 1, 1029, 1030), ("a", 2, 5001, 5004), ("b", 1, 2048, 2060), ("b", 1, 70_000, 75_000), ("b", 1, 89_999, 90_000)],
        "doc_id string, block_no long, quote_start long, quote_end long",
    )
    spans = [
        (doc, block, at, min(at + REACH, end)) for doc, block, start, end in map(tuple, blocks.collect()) for at in range(start, end, 3)
    ]
    asked = quotes.collect()
    wanted = {s for s in spans for q in asked if s[:2] == q[:2] and s[2] < q[3] and s[3] > q[2]}
    parts = [tuple(r) for r in locators.quoted_parts(quotes, blocks, REACH).select("doc_id", "block_no", "part_start", "part_end").collect()]
    held = [s for s in spans for p in parts if s[:2] == p[:2] and p[2] <= s[2] < p[3]]
    assert len(parts) == len(set(parts)) and len(held) == len(set(held)) and wanted <= set(held)
    assert len(held) < len(spans) / 8


def test_blocks_without_quotes_make_no_spans(spark):
    folder = "/root/testdata/sf0.001"
    spans = locator_queries.spans_of(spark, folder)
    quoted = locator_queries.quotes_of(spark, folder).select("doc_id", "block_no").distinct()
    assert spans.join(quoted, ["doc_id", "block_no"], "left_anti").isEmpty() and not spans.isEmpty()
    assert spans.groupBy("doc_id", "block_no", "span_no").count().filter(F.col("count") > 1).isEmpty()
