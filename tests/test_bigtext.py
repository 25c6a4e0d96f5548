"""The two-pass scan against the form that holds a document in a row."""

import random

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import bigtext
from clauseloom.operators import blocks as bl
from clauseloom.operators import locators as lc
from clauseloom.sources.derived import corpus

COLUMNS = ("doc_id", "block_no", "line_no", "line", "text_start", "text_end", "kind", "level", "title", "section_path")


def rows(blocks):
    return sorted(((*r[:-1], tuple(r[-1])) for r in blocks.select(*COLUMNS).collect()), key=str)


def tangled(seed, lines):
    rng = random.Random(seed)
    kinds = ["", "", "plain text", "😀 wide 😀", "# One", "## Two", "### Three", "###### Six", "第一章 甲", "第2节 乙", "1 A", "1.2 B", "1.2.3.4.5.6.7 Deep", "一、丙", "  ", "must comply"]
    return [rng.choice(kinds) + (str(rng.randrange(9)) if rng.random() < 0.3 else "") for _ in range(lines)]


@pytest.mark.parametrize("chunk", [1, 3, 64, 10_000])
def test_any_chunks_give_the_same_blocks(spark, chunk):
    docs = spark.createDataFrame([(f"d{i}", "\n".join(tangled(i, 10 * i))) for i in range(12)] + [("e", ""), ("n", None)], "doc_id string, text string").cache()
    lines = bigtext.split_lines(docs, chunk).repartition(5)
    assert rows(bigtext.sectioned_blocks(lines)) == rows(bl.sectioned_blocks(docs))


def test_on_the_corpus(spark, sf_dir):
    docs = bl.canonical_documents(corpus(spark, sf_dir)).cache()
    assert rows(bigtext.sectioned_blocks(bigtext.split_lines(docs, 7))) == rows(bl.sectioned_blocks(docs))


def test_positions(spark, monkeypatch):
    monkeypatch.setattr(bigtext, "BIN_UNITS", 50)
    docs = spark.createDataFrame([(f"d{i}", "\n".join(tangled(i, 15 * i))) for i in range(1, 6)], "doc_id string, text string").cache()
    ends = {r.doc_id: len(r.text.encode("utf-16-le")) // 2 for r in docs.collect()}
    offsets = spark.createDataFrame([(d, o) for d, n in ends.items() for o in [*range(0, n + 1, 3), n, n, 0]], "doc_id string, offset long")
    got = sorted(map(tuple, bigtext.positions_at(bigtext.split_lines(docs, 4), offsets).collect()))
    assert got == sorted(map(tuple, lc.positions_at(docs, offsets).collect())) and len(got) == offsets.count()
    outside = offsets.groupBy("doc_id").agg((F.max("offset") + 5).alias("offset"))
    assert bigtext.positions_at(bigtext.split_lines(docs, 4), outside).count() == 0


def test_files_in_many_splits(spark, tmp_path):
    texts = {"a.txt": "\n".join(tangled(1, 4000)), "b.txt": "\r\n".join(tangled(2, 300)) + "\r\n", "c.txt": "Café\rone\r\r# Café", "d.txt": "", "e.log": "# no"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = bigtext.file_lines(spark, str(tmp_path), "*.txt")
        assert lines.filter("doc_id LIKE '%a.txt'").select("chunk").distinct().count() > 10
        got = [(r[0].rsplit("/", 1)[1], *r[1:]) for r in rows(bigtext.sectioned_blocks(lines))]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    docs = spark.createDataFrame([(n, t) for n, t in texts.items() if n.endswith("txt")], "doc_id string, text string")
    assert sorted(got, key=str) == rows(bl.sectioned_blocks(bl.canonical_documents(docs)))
