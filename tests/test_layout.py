"""Golden pages: tables, columns, headings, composition, clipping."""

import random

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import checks, layout, metrics, requirements

COLUMNS = (
    "doc_id string, page long, item_index long, text string, t0 double, t1 double, t2 double, t3 double, t4 double, t5 double, "
    "width double, ascent double, descent double, dir string, vertical boolean, has_eol boolean, v0 double, v1 double, v2 double, "
    "v3 double, v4 double, v5 double, page_width double, page_height double"
)


def page(doc, runs):
    """Runs (text, x, y, size) in user space; a new line hint whenever y changes."""
    rows = []
    for i, (text, x, y, size, *width) in enumerate(runs):
        eol = i + 1 == len(runs) or runs[i + 1][2] != y
        advance = width[0] if width else len(text) * size * 0.5
        rows.append((doc, 1, i, text, float(size), 0.0, 0.0, float(size), float(x), float(y), float(advance), 0.9, -0.2, "ltr",
                     False, eol, 1.0, 0.0, 0.0, -1.0, 0.0, 842.0, 595.0, 842.0))
    return rows


PAGES = {
    "table": [("Criterion", 72, 720, 12), ("Response", 330, 720, 12), ("Supplier must sign.", 72, 690, 12), ("Evidence A", 330, 690, 12),
              ("Evidence B", 72, 660, 12), ("Vendor shall seal.", 330, 660, 12)],
    "two_rows": [("1. Scope", 72, 740, 20), ("Context left", 72, 700, 12), ("Context right", 330, 700, 12), ("Other", 72, 660, 12),
                 ("Supplier must comply.", 330, 660, 12)],
    "columns": [("Right must be upper.", 340, 720, 12), ("Left context one.", 72, 705, 12), ("Right shall be lower.", 340, 680, 12),
                ("Left must be upper.", 72, 665, 12), ("Right context two.", 340, 640, 12), ("Left shall be lower.", 72, 625, 12)],
    "band": [("1. Evaluation", 72, 760, 20), ("Right must be upper.", 340, 710, 12), ("Left context one.", 72, 695, 12),
             ("Right shall be lower.", 340, 670, 12), ("Left must be upper.", 72, 655, 12), ("Right context two.", 340, 630, 12),
             ("Left shall be lower.", 72, 615, 12), ("Trailing vendor must comply.", 72, 560, 12)],
    "ranks": [("Major", 265, 760, 24), ("Supplier must comply.", 72, 680, 12), ("Context one", 72, 660, 12), ("Context two", 72, 640, 12),
              ("Context three", 72, 620, 12), ("Subsection", 255, 540, 18.00001), ("Vendor shall comply.", 72, 460, 12),
              ("Context four", 72, 440, 12), ("Context five", 72, 420, 12), ("Context six", 72, 400, 12)],
    "compose": [("Cafe", 72, 700, 12, 24), ("\u0301", 96, 700, 12, 0), ("must comply.", 102, 700, 12, 72)],
    "clipped": [("A", 580, 700, 12), ("Supplier must comply.", 600, 700, 12)],
    "empty": [("   ", 72, 700, 12)],
}


@pytest.fixture(scope="module")
def runs(spark):
    rows = [row for name, items in PAGES.items() for row in page(name, items)]
    return spark.createDataFrame(rows, COLUMNS).cache()


@pytest.fixture(scope="module")
def blocks(runs):
    found = {}
    for r in layout.extract_pages(runs).orderBy("doc_id", "block_no").collect():
        found.setdefault(r.doc_id, []).append(r)
    return found


def texts(rows):
    return [r.text for r in rows]


def test_table_is_row_major(blocks):
    assert [r.kind for r in blocks["table"]] == ["table-cell"] * 6
    assert texts(blocks["table"]) == [t[0] for t in PAGES["table"]]


def test_two_rows_are_no_table(blocks):
    assert "table-cell" not in {r.kind for r in blocks["two_rows"]}
    assert list(blocks["two_rows"][-1].section_path) == ["Scope"]


def test_columns_left_first(blocks):
    left, right = ["Left context one.", "Left must be upper.", "Left shall be lower."], ["Right must be upper.", "Right shall be lower.", "Right context two."]
    assert texts(blocks["columns"]) == left + right
    assert texts(blocks["band"]) == ["1. Evaluation", *left, *right, "Trailing vendor must comply."]
    assert blocks["band"][0].kind == "heading" and list(blocks["band"][-1].section_path) == ["Evaluation"]


def test_font_ranks_give_levels(blocks):
    assert [(r.text, list(r.section_path)) for r in blocks["ranks"] if r.kind == "heading"] == [
        ("Major", ["Major"]), ("Subsection", ["Major", "Subsection"]),
    ]


def test_composition_joins_the_boxes(blocks):
    (block,) = blocks["compose"]
    assert block.text == "Café must comply." and (block.text_start, block.text_end) == (0, 17)
    assert [(s.text_start, s.text_end) for s in block.spans] == [(0, 4), (5, 17)]


def test_clipped_text_is_left_out(blocks):
    assert texts(blocks["clipped"]) == ["A"]


def test_documents_without_text_need_ocr(runs):
    located = layout.with_region(layout.item_geometry(runs))
    assert [r.doc_id for r in layout.needs_ocr(runs, located).collect()] == ["empty"]


def test_oversized_documents_fail_whole(runs):
    kept, failed = layout.within_item_limit(runs, 6)
    assert {r.doc_id for r in failed.collect()} == {"band", "ranks"}
    assert not {"band", "ranks"} & {r.doc_id for r in kept.select("doc_id").distinct().collect()}


def test_substring_join_equals_brute_force(spark):
    outline = spark.createDataFrame(
        [("p", 1, "3.2", "Plan"), ("p", 2, "3", "X"), ("q", 3, "3.2", "Plan")], "project_id string, id long, number string, title string"
    )
    issues = spark.createDataFrame(
        [("p", 10, "3.2.1 details"), ("p", 11, "the Plan"), ("p", 12, ""), ("q", 13, "nothing"), ("q", 14, "X")],
        "project_id string, id long, location string",
    )
    want = {
        (o.id, i.id) for o in outline.collect() for i in issues.collect()
        if o.project_id == i.project_id and (o.number in i.location or o.title in i.location)
    }
    got = [(r.section_id, r.issue_id) for r in metrics.section_issues(outline, issues).collect()]
    assert set(got) == want and len(got) == len(want)


def test_duplicate_content_equals_brute_force(spark):
    base = [f"w{i} alpha beta gamma delta" for i in range(12)]
    texts_ = {
        1: " ".join(base), 2: " ".join(base), 3: " ".join(base[:-1]) + " tail", 4: " ".join(reversed(base)),
        5: "short", 6: "short", 7: "entirely different words appear here only once", 8: " ".join(base) + " end",
    }
    rows = spark.createDataFrame(list(texts_.items()), "id long, text string")
    sets = {r.id: set(r.s) for r in rows.select("id", checks._shingles(F.col("text")).alias("s")).collect()}
    first = {t: min(k for k, v in texts_.items() if v == t) for t in texts_.values()}
    ids = sorted(first.values())
    similar = {
        a: any(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.8 for b in ids if b != a) for a in ids
    }
    got = checks.duplicate_content(rows).collect()
    assert {r.id: r.similar for r in got} == similar
    assert {r.id: r.copies for r in got} == {i: sum(t == texts_[i] for t in texts_.values()) for i in ids}


def test_page_steps_share_their_partitioning(spark, runs):
    """From runs to judged segments a row is shuffled three times at most: to its page, behind the line fold and behind the texts."""
    items = layout.with_flow_class(layout.with_dominant_flow(layout.layout_items(runs)))
    spaced = layout.with_spacing(layout.segment_texts(layout.with_lines(layout.with_body_font(items))))
    judged = layout.with_columns(layout.with_tables(layout.with_headings(spaced)))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 3 and "Join" not in plan


def test_batch_borders_change_no_page(spark, runs):
    """Lines and segments go on where an Arrow batch ends."""
    def rows():
        return sorted((tuple(map(str, r)) for r in layout.extract_pages(runs).collect()))

    whole, key = rows(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        assert rows() == whole
    finally:
        spark.conf.set(key, before)


def test_texts_without_shared_shingles_write_no_sets(spark, monkeypatch):
    written = []
    keep = checks.materialize
    monkeypatch.setattr(checks, "materialize", lambda df, label: written.append((label, keep(df, label))) or written[-1][1])
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(20)] + [(50, "a b c d e f"), (51, "a b c d e f"), (52, "z a b c d e f")]
    got = {r.id: (r.copies, r.similar) for r in checks.duplicate_content(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {**{i: (1, False) for i in range(20)}, 50: (2, False), 52: (1, False)}
    assert {label: df.count() for label, df in written if "shingles" in label}["shared-shingles"] == 2


def test_page_without_a_direction_keeps_its_runs_in_order(spark):
    rows = [(*r[:13], "rtl", *r[14:]) for r in page("sideways", [("One must sign.", 72, 700, 12), ("Two", 300, 700, 12), ("Three", 72, 600, 12)])]
    found = layout.extract_pages(spark.createDataFrame(rows, COLUMNS)).orderBy("block_no").collect()
    assert [(r.text, r.kind, len(r.spans)) for r in found] == [(t, "paragraph", 1) for t in ("One must sign.", "Two", "Three")]


def test_blank_runs_need_no_geometry(spark):
    rows = page("blank", [("Text", 72, 700, 12), ("Same line", 300, 700, 12)])
    rows += [("blank", 1, 2, "  ", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.9, -0.2, "ltr", False, True, 1.0, 0.0, 0.0, -1.0, 0.0, 842.0, 0.0, 0.0)]
    assert texts(layout.extract_pages(spark.createDataFrame(rows, COLUMNS)).orderBy("block_no").collect()) == ["Text", "Same line"]


def test_extraction_shuffles_a_run_and_a_segment_once(spark, runs, monkeypatch):
    """No join, no written intermediate; documents beyond the limit are left out whole."""
    plan = layout.extract_pages(runs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "Join" not in plan and "Aggregate" not in plan and plan.count("Sort [") <= 7
    monkeypatch.setitem(layout.fv.LIMITS, "spans", 6)
    kept = {r.doc_id for r in layout.extract_pages(runs).select("doc_id").distinct().collect()}
    assert "table" in kept and not {"band", "ranks"} & kept


def test_segments_of_lined_items_are_those_of_items(spark, runs):
    items = layout.with_flow_class(layout.with_dominant_flow(layout.layout_items(runs)))
    own, lined = layout.segment_texts(items), layout.segment_texts(layout.with_lines(items))
    assert sorted(map(str, own.collect())) == sorted(map(str, lined.select(*own.columns).collect()))


def test_section_paths_equal_a_stack(spark):
    """Paths by windows against the rule itself, with levels beyond both ends and missing titles' places."""
    rng = random.Random(4)
    rows, want = [], {}
    for doc in range(40):
        path = []
        for n in range(rng.randrange(1, 60)):
            level = rng.choice((None, None, 0, 1, 1, 2, 2, 3, 4, 5, 9, 12))
            if level is not None:
                at = min(max(level, 1), 9)
                path = [*(path[: at - 1] if at <= len(path) + 1 else path), f"t{n}"]
            rows.append((f"d{doc}", n, level, None if level is None else f"t{n}"))
            want[f"d{doc}", n] = path
    rng.shuffle(rows)
    made = layout.with_paths(spark.createDataFrame(rows, "doc_id string, block_no long, level long, title string"), "block_no")
    assert {(r.doc_id, r.block_no): list(r.section_path) for r in made.collect()} == want


def test_regions_are_cut_before_requirements_are_shuffled(spark, runs):
    plan = requirements.extract_pdf_requirements(runs)._jdf.queryExecution().optimizedPlan().toString()
    behind = plan[: plan.index("RepartitionByExpression")]
    assert "regions" in behind and "spans" not in behind and "region#" not in behind


def test_runs_are_dealt_over_all_tasks_whatever_their_bytes(runs):
    plan = layout.item_geometry(runs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange ") == 1
