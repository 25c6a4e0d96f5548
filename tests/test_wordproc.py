from pyspark.sql import functions as F

from clauseloom.operators import wordproc as wp
from clauseloom.plans.docx_queries import documents
from clauseloom.sources.docx import SCHEMA


def test_every_archive_is_read_once(spark, sf_dir):
    plan = wp.extract_blocks(documents(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    # One pass builds the sample archives, one reads them.
    assert plan.count("MapInPandas") == 2


def test_lists_are_resolved_in_the_row(spark):
    row = (
        "d", None, [], [], [("1", "a"), ("2", "a"), ("3", "gone"), ("4", "a")],
        [("a", 0, 1, "decimal", "%1."), ("a", 1, 5, "lowerLetter", "%2)")],
        [("2", 0, 7, None, None, None), ("2", 2, None, 3, "upperRoman", "%3"), ("4", 1, None, 9, None, "half"), ("3", 0, 1, 1, "decimal", "%1")],
    )
    lists = spark.createDataFrame([row], SCHEMA).select(
        wp.list_levels(F.col("nums"), F.col("levels"), F.col("overrides")).alias("lists")
    ).first().lists
    assert {k: {n: tuple(v) for n, v in levels.items()} for k, levels in lists.items()} == {
        "1": {0: (1, "decimal", "%1."), 1: (5, "lowerLetter", "%2)")},
        "2": {0: (7, "decimal", "%1."), 1: (5, "lowerLetter", "%2)"), 2: (3, "upperRoman", "%3")},
        "4": {0: (1, "decimal", "%1."), 1: (5, "lowerLetter", "%2)")},
    }


def test_rejected_documents_come_back(spark):
    rows = [("good", None, [], [], [], [], []), ("bad", "INVALID_DOCX", [], [], [], [], [])]
    found = wp.rejected(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in found] == [("bad", "INVALID_DOCX")]
