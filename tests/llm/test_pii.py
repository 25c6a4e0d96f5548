import hashlib
import random
import re

from pyspark.sql import functions as F

from clauseloom.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), number, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_formats_against_plain_patterns():
    rng = random.Random(3)
    parts = ["a", "@", "b.c", "1", "23", "4539578763621486", ".", " ", "-", "+1", "(5)", "255", "é", "_", "@x.y", "000"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)


def test_long_runs_are_quick():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "1 " * 100_000):
        pii.base_spans(text)


def test_query_against_plain_patterns(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op2_pii(spark, sf_dir).collect()}
    assert len(got) == documents.count()
    for r in documents.select("doc_id", "text").collect():
        spans, row = plain_spans(r.text), got[r.doc_id]
        listed = [f"{k}:{s}:{e}" for s, e, k in spans]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(row.spans.split(",")) | {""}
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == kind for *_, k in spans) for kind in PLAIN]


def planted(spark):
    """Phones after "call me on" teach the context; short numbers there are found, the same elsewhere are not."""
    rows = [(i, f"{w} please call me on +1 (555) 123-4{i:03d} after noon {w}") for i, w in enumerate("abcdefgh")]
    rows += [(100, "then call me on 5551234 after noon"), (101, "sold 5551234 units in may"), (102, "serial 99887766 of the part")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_find_unseen_identifiers(spark):
    rows = {r.doc_id: r for r in pii.personal_spans(planted(spark)).select("doc_id", pii.span_list(F.col("spans")).alias("spans"), pii.span_list(F.col("base")).alias("base")).collect()}
    assert rows[100].spans == "id:16:23" and rows[100].base == ""
    assert rows[101].spans == rows[102].spans == ""
    masked = {r.doc_id: r.text for r in pii.mask_documents(planted(spark)).collect()}
    assert masked[100] == "then call me on <id> after noon" and masked[101] == "sold 5551234 units in may"
    assert masked[0] == "a please call me on <phone> after noon a"


def test_confidence_spreads_over_the_graph(spark):
    """Pattern p meets seeds and x; x, trusted through p, vouches with others for q, which then finds y."""
    seen = [("p", f"s{i}", True) for i in range(8)] + [("p", f"x{i}", False) for i in range(2)]
    seen += [("q", f"s{i}", True) for i in range(3)] + [("q", "x0", False), ("q", "x1", False)] + [("r", "y", False)]
    rows = spark.createDataFrame(seen, "pattern string, instance string, seed boolean")
    once = {r.pattern for r in pii.confident_patterns(rows, rounds=1, confidence=0.75, support=4, prior=0.2).collect()}
    thrice = {r.pattern for r in pii.confident_patterns(rows, rounds=3, confidence=0.75, support=4, prior=0.2).collect()}
    assert once == {"p"} and thrice == {"p", "q"}


def test_odd_rows(odd, empty):
    rows = pii.personal_spans(odd).collect()
    assert len(rows) == odd.count()
    assert sum(len(r.base) for r in rows) == 2 and all(r.spans == [] for r in rows if r.doc_id is not None)
    masked = pii.mask_documents(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    assert masked.filter("text like 'Mail me at <email> or <phone> now'").count() == 1
    assert pii.personal_spans(empty).count() == 0 and pii.mask_documents(empty).count() == 0
