"""Requirements of DOCX and PDF blocks against plain Python over the same blocks."""

from clauseloom.operators import layout as ly
from clauseloom.operators import requirements as rq
from clauseloom.plans.layout_queries import runs


def units(text):
    return len(text.encode("utf-16-le")) // 2


def test_page_requirements_lie_in_their_blocks(spark, sf_dir):
    pages = runs(spark, sf_dir).cache()
    blocks = {}
    for b in ly.extract_pages(pages).collect():
        blocks.setdefault(b.doc_id, []).append(b)
    found = rq.extract_pdf_requirements(pages).collect()
    assert found
    numbers = {}
    for r in found:
        block = next(b for b in blocks[r.doc_id] if b.block_no == r.block_no)
        assert block.kind != "heading" and block.section_path == r.section_path
        cut = block.text.encode("utf-16-le")[2 * (r.quote_start - block.text_start) : 2 * (r.quote_end - block.text_start)]
        assert cut.decode("utf-16-le") == r.quote and units(r.quote) == r.quote_end - r.quote_start
        touched = []
        for s in block.spans:
            if s.text_start < r.quote_end and s.text_end > r.quote_start and (block.page, s.region) not in touched:
                touched.append((block.page, s.region))
        assert touched and [(x.page, x.box) for x in r.regions] == touched
        numbers.setdefault(r.doc_id, []).append((r.quote_start, r.code))
    for pairs in numbers.values():
        assert [code for _, code in sorted(pairs)] == [f"REQ-{i + 1:04d}" for i in range(len(pairs))]


def test_documents_over_the_item_limit_come_back(spark, sf_dir):
    pages = runs(spark, sf_dir).cache()
    counts = {r.doc_id: r["count"] for r in pages.groupBy("doc_id").count().collect()}
    limit = sorted(counts.values())[len(counts) // 2]
    kept, failed = ly.within_item_limit(pages, limit)
    assert {r.doc_id: r.items for r in failed.collect()} == {d: n for d, n in counts.items() if n > limit}
    assert {r.doc_id for r in kept.select("doc_id").distinct().collect()} == {d for d, n in counts.items() if n <= limit}
