"""Values in their canonical form, and what a project's documents agree on."""

import random
from collections import Counter, defaultdict

import pytest

from clauseloom.functions import values
from clauseloom.operators import fields


@pytest.mark.parametrize(("text", "number"), [
    ("十", 10), ("十二", 12), ("二十", 20), ("一百零五", 105), ("一千二百三十四", 1234), ("三万", 30_000), ("一百二十万", 1_200_000), ("一亿二千万", 120_000_000), ("二〇二六", 2026),
    ("壹佰贰拾叁万肆仟伍佰", 1_234_500), ("十万零三", 100_003), ("零", 0), ("甲", None), ("", None),
])
def test_chinese_numbers(text, number):
    assert values.chinese_number(text) == number


@pytest.mark.parametrize(("kind", "text", "value"), [
    ("date", "2026-07-10 09:30", "2026-07-10"), ("date", "2026年7月10日（周五）", "2026-07-10"), ("date", "二〇二六年七月十日", "2026-07-10"), ("date", "before July 10th, 2026", "2026-07-10"),
    ("date", "10 Jul 2026", "2026-07-10"), ("date", "2026/2/30", None), ("date", "soon", None), ("date", "2024.02.29", "2024-02-29"),
    ("amount", "人民币1,200,000.50元", "CNY 1200000.5"), ("amount", "120万元", "CNY 1200000"), ("amount", "RMB 1.2 million", "CNY 1200000"), ("amount", "USD 5,000", "USD 5000"),
    ("amount", "一百二十万元整", "CNY 1200000"), ("amount", "3 lots, € 2bn", "EUR 2000000000"), ("amount", "1200000", None), ("amount", "$12 months", "USD 12"), ("amount", "约¥0.5亿", "CNY 50000000"),
    ("duration", "180日历天", "180 d"), ("duration", "26 weeks", "182 d"), ("duration", "九十天", "90 d"), ("duration", "90 calendar days", "90 d"), ("duration", "one day", None),
    ("name", "  Ｗorks  7　new site。", "works 7 new site"), ("name", "。", None), ("code", " zb- 2026 ‐ 1 ", "ZB-2026‐1"), ("other", "x", None), ("date", None, None),
])
def test_canonical_forms(spark, kind, text, value):
    reader = values.KINDS.get(kind)
    assert (reader(text) if reader and text is not None else None) == value


def test_unknown_kinds_and_nulls(spark):
    rows = spark.createDataFrame([("date", "2026-01-02"), ("none", "x"), ("name", None), (None, "x")], "kind string, raw string")
    assert [r[0] for r in rows.select(values.canonical_value("kind", "raw")).collect()] == ["2026-01-02", None, None, None]


def test_labels(spark):
    text = "1. 项目名称： 新址工程 \nProject Name: New Site\nproject name without a mark\n  投标截止时间:2026年7月10日\r\n（二）招标编号：ZB-1。\nthe budget: 5\n最高限价：面议\n：\nBudget： USD 1,000"
    docs = spark.createDataFrame([("t", "P", "d1", text), ("t", "P", "d2", None), ("t", "P", "d3", "")], "tenant string, project string, doc_id string, text string")
    got = [(r.doc_id, r.field, r.line_no, r.raw, r.value) for r in fields.document_fields(docs).orderBy("line_no").collect()]
    assert got == [
        ("d1", "project_name", 1, "新址工程", "新址工程"), ("d1", "project_name", 2, "New Site", "new site"), ("d1", "bid_deadline", 4, "2026年7月10日", "2026-07-10"),
        ("d1", "project_code", 5, "ZB-1。", "ZB-1"), ("d1", "budget", 7, "面议", None), ("d1", "budget", 9, "USD 1,000", "USD 1000"),
    ]


def test_votes_against_counting(spark):
    rng = random.Random(6)
    rows = [("t", f"P{rng.randrange(5)}", f"d{rng.randrange(40)}", rng.choice(("budget", "duration")), n, "raw", rng.choice(("a", "b", "c", None))) for n in range(300)]
    table = spark.createDataFrame(rows, "tenant string, project string, doc_id string, field string, line_no long, raw string, value string").repartition(4)
    votes = defaultdict(Counter)
    for tenant, project, field, value, _ in {(r[0], r[1], r[3], r[6], r[2]) for r in rows if r[6] is not None}:
        votes[tenant, project, field][value] += 1
    best = {key: min(c, key=lambda v: (-c[v], v)) for key, c in votes.items()}
    got = {(r.tenant, r.project, r.field): (r.value, r.documents, r.versions) for r in fields.field_consensus(table, "tenant", "project").collect()}
    assert got == {k: (v, votes[k][v], len(votes[k])) for k, v in best.items()}
    wrong = sorted((r[1], r[3], r[2], r[4]) for r in rows if r[6] != best[r[0], r[1], r[3]])
    assert sorted((r.project, r.field, r.doc_id, r.line_no) for r in fields.field_conflicts(table, "tenant", "project").collect()) == wrong
    assert fields.field_conflicts(table.limit(0), "tenant", "project").count() == 0
