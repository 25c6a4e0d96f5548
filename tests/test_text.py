"""Golden cases for text structure, sentences, rules and extraction, plus a plain-Python model."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv
from clauseloom.functions import signals, text
from clauseloom.operators import blocks as bl
from clauseloom.operators import requirements as rq
from clauseloom.operators import sentences as se


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def extract(spark, source):
    rows = rq.extract_txt_requirements(docs(spark, source)).orderBy("quote_start").collect()
    return rows


def test_canonical_text_and_blocks(spark):
    raw = "Cafe\u0301\r\n\r\n  \rTail\ufeff"
    rows = bl.line_blocks(bl.canonical_documents(docs(spark, raw))).orderBy("block_no").collect()
    assert [(r.line, r.text_start, r.text_end, r.line_no) for r in rows] == [
        ("Café", 0, 4, 1), ("  ", 6, 8, 3), ("Tail\ufeff", 9, 14, 4),
    ]


def test_utf16_offsets(spark):
    rows = bl.line_blocks(docs(spark, "😀 must comply\n尾行")).orderBy("block_no").collect()
    assert [(r.text_start, r.text_end) for r in rows] == [(0, 14), (15, 17)]


def test_long_documents_keep_their_offsets(spark):
    lines = ["" if i % 3 == 0 else f"line {i}" for i in range(300)]
    rows = bl.line_blocks(docs(spark, "\n".join(lines))).orderBy("block_no").collect()
    starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(300)]
    assert [(r.line_no, r.text_start) for r in rows] == [(i + 1, starts[i]) for i in range(300) if lines[i]]


def test_section_paths(spark):
    source = "\n".join(
        ["# Root", "body", "### Deep", "body 2", "## Peer", "body 3", "第十二章 合规", "第3节 证书", "1.12.3 技术",
         "body 4", "2 商务", "body 5", "一、中文标题", "body 6"]
    )
    rows = bl.sectioned_blocks(docs(spark, source)).orderBy("block_no").collect()
    assert [list(r.section_path) for r in rows if r.kind == "heading"] == [
        ["Root"], ["Root", "Deep"], ["Root", "Peer"], ["合规"], ["合规", "证书"], ["合规", "证书", "技术"], ["商务"], ["中文标题"],
    ]
    assert [list(r.section_path) for r in rows if r.kind == "paragraph"] == [
        ["Root"], ["Root", "Deep"], ["Root", "Peer"], ["合规", "证书", "技术"], ["商务"], ["中文标题"],
    ]


def test_heading_safety(spark):
    source = "\n".join(["# Safe heading", "# Supplier must comply", "## Evaluation worth 5 points", "# Sentence.", "# " + "x" * 119])
    rows = bl.sectioned_blocks(docs(spark, source)).orderBy("block_no").collect()
    assert [r.kind for r in rows] == ["heading"] + ["paragraph"] * 4


HARD = [
    "The supplier MUST encrypt data.", "The supplier shall encrypt data.", "供应商必须加密数据。", "供应商不得泄露数据。",
    "供应商应当提交方案。", "供应商须提供证明。",
]
SCORE = [
    "最高得10分。", "最高可得 9 分。", "最高为8分。", "满分7分。", "满分为 6 分。", "得5分。", "计4分。", "赋3分。", "分值2分。", "分值为 1.5 分。",
    "This item is worth 10 points.", "This item is awarded 9 points.", "This item scores 8 points.",
    "The maximum of 7 points applies.", "The max 6 points applies.", "The response receives 5 points.",
]
NEITHER = [
    "Mustard is yellow and shallots are vegetables.", "本事项无需办理，也无须办理，请阅读投标须知。",
    "See page 10, version 2.1, and allow 5 days.", "The supplier provides documentation.", "本项说明服务内容。",
    "The maximum response length is 10 pages.", "合计10分钟。", "最高为8分贝。", "计10分米。", "The supplier says émust comply.",
    "The supplier shallé comply.", "The item is worth 5 pointsé.",
]


def test_signals(spark):
    rows = spark.createDataFrame([(t,) for t in HARD + SCORE + NEITHER], "t string").select(
        "t", signals.has_hard(F.col("t")).alias("h"), signals.has_score(F.col("t")).alias("s"),
        signals.may_signal(F.col("t")).alias("m"),
    ).collect()
    want = {**{t: (True, False) for t in HARD}, **{t: (False, True) for t in SCORE}, **{t: (False, False) for t in NEITHER}}
    assert {r.t: (r.h, r.s) for r in rows} == want
    assert all(r.m for r in rows if r.h or r.s)


@pytest.mark.parametrize(
    ("quote", "category"),
    [("Certificates must remain valid.", "compliance"), ("Payments must be traceable.", "commercial"),
     ("Taxes shall be included.", "commercial"), ("Coffee must remain hot.", "technical")],
)
def test_category(spark, quote, category):
    assert [r.category for r in extract(spark, quote)] == [category]


def test_sentences_and_codes(spark):
    source = "  Supplier must support version 1.2.  Vendor shall sign；  报价最高得 10 分。  "
    rows = extract(spark, source)
    assert [(r.quote, r.quote_start) for r in rows] == [
        ("Supplier must support version 1.2.", source.index("Supplier")), ("Vendor shall sign；", source.index("Vendor")),
        ("报价最高得 10 分。", source.index("报价")),
    ]
    again = extract(spark, "Zulu must work.\nAlpha shall work.\nZulu must work.\nBeta最高得5分。")
    assert [(r.code, r.quote) for r in again] == [
        ("REQ-0001", "Zulu must work."), ("REQ-0002", "Alpha shall work."), ("REQ-0003", "Beta最高得5分。"),
    ]


def test_section_decides_category_and_confidence(spark):
    source = "# Pricing\nSupplier must provide signature and pricing worth 10 points.\n# Commercial\n方案最高得8分。\n# Technical\nSupplier shall encrypt data."
    rows = extract(spark, source)
    assert [(r.category, r.priority, float(r.confidence)) for r in rows] == [
        ("compliance", "mandatory", 0.98), ("commercial", "important", 0.9), ("technical", "mandatory", 0.95),
    ]


def test_codes_grow_past_four_digits(spark):
    found = spark.range(10_001).select(
        F.lit("d").alias("doc_id"), F.col("id").alias("quote_start"), F.col("id").alias("quote_end")
    )
    last = rq.with_codes(found).orderBy(F.desc("quote_start")).first()
    assert last.code == "REQ-10001"


def test_nfc_safe_ranges_are_stable():
    seconds = set(range(0x1161, 0x1176)) | set(range(0x11A7, 0x11C3))
    for point in range(0x110000):
        parts = unicodedata.decomposition(chr(point))
        if parts and not parts.startswith("<") and " " in parts:
            seconds.add(int(parts.split()[1], 16))
    for low, high in re.findall(r"\\x\{([0-9A-F]+)\}-\\x\{([0-9A-F]+)\}", text.NFC_SAFE):
        for point in range(int(low, 16), int(high, 16) + 1):
            char = chr(point)
            assert unicodedata.combining(char) == 0 and unicodedata.normalize("NFC", char) == char
            assert point not in seconds


def _model(source: str) -> list[tuple[str, int]]:
    """Sentences of one line by a character loop."""
    ws, out, start = set(text.WS_CHARS), [], 0
    units = lambda s: len(s.encode("utf-16-le")) // 2
    for i, char in enumerate(source + "\0"):
        last = i == len(source)
        following = source[i + 1] if i + 1 < len(source) else " "
        if last or char in fv.SENTENCE_MARKS or (char == "." and following in ws):
            raw = source[start:] if last else source[start : i + 1]
            lead = len(raw) - len(raw.lstrip(text.WS_CHARS))
            quote = raw.strip(text.WS_CHARS)
            if quote:
                out.append((quote, units(source[: start + lead])))
            start = i + 1
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab. !；。\u3000\ufeff\u0085😀?", min_size=1, max_size=60), min_size=40, max_size=40))
def test_sentences_match_a_plain_model(spark, lines):
    rows = spark.createDataFrame([(i, x, 0) for i, x in enumerate(lines)], "i int, line string, text_start long")
    got: dict[int, list] = {}
    for r in se.split_sentences(rows).orderBy("i", "piece_no").collect():
        got.setdefault(r.i, []).append((r.quote, r.quote_start))
    assert got == {i: _model(x) for i, x in enumerate(lines) if _model(x)}
