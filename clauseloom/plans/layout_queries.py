"""Page layout over positioned text derived from the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv
from clauseloom.functions.signals import page_heading
from clauseloom.operators import blocks as bl
from clauseloom.operators import layout as ly
from clauseloom.operators import requirements as rq
from clauseloom.plans.catalog import entry
from clauseloom.plans.oracle_parts import PARTS, WS, blank, hard, score, trim, u16
from clauseloom.plans.text_queries import canonical
from clauseloom.sources.derived import derive

_R6 = "floor(({0}) * 1000000 + 0.5) / 1000000"


def _r6(expr: str) -> str:
    return _R6.format(expr)


PARTS["run_geo"] = (
    ("text_runs",),
    f"""
    SELECT doc_id, page, item_index, text, k, idx, m0 / fl AS flow_x, m1 / fl AS flow_y, m2 / fh AS up_x, m3 / fh AS up_y, ox, oy, width * scale AS advance, fh AS font_height,
           CASE WHEN ascent > 0 AND ascent <= 2 AND descent BETWEEN -1 AND 0 AND ascent - descent <= 3 THEN ascent ELSE 0.8::DOUBLE END AS ascent,
           CASE WHEN ascent > 0 AND ascent <= 2 AND descent BETWEEN -1 AND 0 AND ascent - descent <= 3 THEN descent ELSE -0.2::DOUBLE END AS descent,
           dir = 'ltr' AND NOT vertical AS structural, line_hint, scale, page_width, page_height
    FROM (SELECT *, sqrt(m0 * m0 + m1 * m1) AS fl, sqrt(m2 * m2 + m3 * m3) AS fh, sqrt(v0 * v0 + v1 * v1) AS scale,
                 CAST(coalesce(sum(has_eol::INT) OVER (PARTITION BY doc_id, page ORDER BY item_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_hint
          FROM (SELECT *, v0 * t0 + v2 * t1 AS m0, v1 * t0 + v3 * t1 AS m1, v0 * t2 + v2 * t3 AS m2, v1 * t2 + v3 * t3 AS m3,
                       v0 * t4 + v2 * t5 + v4 AS ox, v1 * t4 + v3 * t5 + v5 AS oy FROM text_runs))
    WHERE NOT {blank('text')}""",
)
_X = [f"ox + flow_x * {a} + up_x * ({e} * font_height)" for a in ("0", "advance") for e in ("descent", "ascent")]
_Y = [f"oy + flow_y * {a} + up_y * ({e} * font_height)" for a in ("0", "advance") for e in ("descent", "ascent")]
PARTS["run_box"] = (
    ("run_geo",),
    f"""
    SELECT * REPLACE (CASE WHEN seen THEN x END AS x, CASE WHEN seen THEN y END AS y, CASE WHEN seen THEN w END AS w, CASE WHEN seen THEN h END AS h)
    FROM (SELECT *, r > l AND b > t AND w > 0 AND h > 0 AS seen
          FROM (SELECT *, least({_r6('(r - l) / page_width')}, {_r6('1 - x')}) AS w, least({_r6('(b - t) / page_height')}, {_r6('1 - y')}) AS h
                FROM (SELECT *, {_r6('l / page_width')} AS x, {_r6('t / page_height')} AS y
                      FROM (SELECT *, greatest(0::DOUBLE, least({', '.join(_X)})) AS l, least(page_width, greatest({', '.join(_X)})) AS r,
                                   greatest(0::DOUBLE, least({', '.join(_Y)})) AS t, least(page_height, greatest({', '.join(_Y)})) AS b FROM run_geo))))""",
)
PARTS["run_pages"] = (
    ("run_box",),
    f"""
    SELECT doc_id, page, CASE WHEN cos(axis) * lx + sin(axis) * ly < 0 THEN -1 ELSE 1 END * cos(axis) AS dx, CASE WHEN cos(axis) * lx + sin(axis) * ly < 0 THEN -1 ELSE 1 END * sin(axis) AS dy
    FROM (SELECT doc_id, page, atan2(sum(sin(2 * atan2(flow_y, flow_x)) * n), sum(cos(2 * atan2(flow_y, flow_x)) * n)) / 2 AS axis, sum(flow_x * n) AS lx, sum(flow_y * n) AS ly
          FROM (SELECT *, greatest(1, {u16('text')}) AS n FROM run_box WHERE seen AND structural) GROUP BY doc_id, page)""",
)
PARTS["run_flow"] = (
    ("run_box", "run_pages"),
    """
    SELECT b.*, p.dx, p.dy, coalesce(structural AND acos(least(1, abs(flow_x * dx + flow_y * dy))) <= pi() / 60, false) AS in_flow,
           ox * dx + oy * dy AS start, oy * dx - ox * dy AS coordinate, ox * dx + oy * dy + advance * abs(flow_x * dx + flow_y * dy) AS finish
    FROM run_box b LEFT JOIN run_pages p USING (doc_id, page) WHERE b.seen""",
)
# In this data a line is exactly one line hint.
PARTS["run_lines"] = (
    ("run_flow",),
    "SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line_hint) - 1 AS BIGINT) AS line_no FROM run_flow WHERE in_flow",
)
PARTS["run_split"] = (
    ("run_lines",),
    """
    SELECT *, CAST(sum((gap > 1.5 * em)::INT) OVER w AS BIGINT) AS segment_no, CAST(sum((gap >= 0.2 * em OR gap > 1.5 * em)::INT) OVER w AS BIGINT) AS word_no
    FROM (SELECT *, coalesce(start - lag(finish) OVER o, -1000) AS gap, greatest(1, (font_height + lag(font_height) OVER o) / 2) AS em
          FROM run_lines WINDOW o AS (PARTITION BY doc_id, page, line_no ORDER BY start, item_index))
    WINDOW w AS (PARTITION BY doc_id, page, line_no ORDER BY start, item_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
PARTS["run_segments"] = (
    ("run_split",),
    f"""
    SELECT doc_id, page, line_no, segment_no, string_agg(word, ' ' ORDER BY word_no) AS text, sum(n) AS items, min(start) AS start,
           arg_max(finish, word_no) AS finish, sum(fonts) / sum(units) AS font_height, any_value(lc) AS line_coordinate,
           any_value(page_width) AS page_width, any_value(page_height) AS page_height, any_value(scale) AS scale, any_value(dx) AS dx, any_value(dy) AS dy,
           min(x) AS x, min(y) AS y, max(r) AS r, max(b) AS b
    FROM (SELECT doc_id, page, line_no, segment_no, word_no, string_agg(text, '' ORDER BY start, item_index) AS word, count(*) AS n, min(start) AS start, arg_max(finish, start) AS finish,
                 sum(font_height * {u16('text')}) AS fonts, sum({u16('text')}) AS units, any_value(lc) AS lc, any_value(page_width) AS page_width, any_value(page_height) AS page_height,
                 any_value(scale) AS scale, any_value(dx) AS dx, any_value(dy) AS dy, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b
          FROM (SELECT *, avg(coordinate) OVER (PARTITION BY doc_id, page, line_no) AS lc FROM run_split) GROUP BY doc_id, page, line_no, segment_no, word_no)
    GROUP BY doc_id, page, line_no, segment_no""",
)
PARTS["run_body"] = (
    ("run_lines",),
    f"""
    SELECT doc_id, page, CASE WHEN count(*) >= 2 THEN min(font_height) FILTER (WHERE upto * 2 >= total) END AS body_font
    FROM (SELECT doc_id, page, font_height, sum({u16('text')}) OVER (PARTITION BY doc_id, page ORDER BY font_height) AS upto,
                 sum({u16('text')}) OVER (PARTITION BY doc_id, page) AS total FROM run_lines) GROUP BY doc_id, page""",
)
PARTS["run_line_rows"] = (
    ("run_segments",),
    """
    SELECT *, lc - lag(lc) OVER w AS before, lead(lc) OVER w - lc AS after FROM (
      SELECT doc_id, page, line_no, count(*) AS segments, any_value(line_coordinate) AS lc FROM run_segments GROUP BY ALL)
    WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)""",
)
PARTS["run_typical"] = (
    ("run_line_rows",),
    "SELECT doc_id, page, median(before) FILTER (WHERE before > 0) AS typical FROM run_line_rows GROUP BY ALL",
)
_TITLE_OK = (
    f"({u16('text')} <= 120 AND length(text) > 0 AND NOT {hard('text')} AND NOT {score('text')}"
    rf" AND NOT regexp_matches(text, '[。！？；!?;.]{WS}*\z'))"
)
_LARGE = "coalesce(body_font > 0 AND font_height >= 1.25 * body_font, false)"
PARTS["run_singles"] = (
    ("run_segments", "run_line_rows", "run_body", "run_typical"),
    f"""
    SELECT s.*, l.before, l.after, b.body_font, t.typical, floor(font_height / scale * 4 + 0.5) / 4 AS bucket, {_LARGE} AS large
    FROM run_segments s JOIN run_line_rows l ON l.doc_id = s.doc_id AND l.page = s.page AND l.line_no = s.line_no AND l.segments = 1
    LEFT JOIN run_body b ON b.doc_id = s.doc_id AND b.page = s.page LEFT JOIN run_typical t ON t.doc_id = s.doc_id AND t.page = s.page
    WHERE {_TITLE_OK}""",
)
PARTS["run_ranks"] = (
    ("run_singles",),
    """
    SELECT doc_id, page, bucket, least(9, row_number() OVER (PARTITION BY doc_id, page ORDER BY bucket DESC)) AS rank
    FROM (SELECT DISTINCT doc_id, page, bucket FROM run_singles WHERE large)""",
)


def page_title(expr: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({expr}, '{p}') THEN {trim(f'regexp_extract({expr}, {chr(39)}{p}{chr(39)}, {g})')}"
        for p, g in ((fv.PAGE_MARKDOWN, 2), (fv.PAGE_CHAPTER, 2), (fv.PAGE_DECIMAL, 2), (fv.PAGE_CHINESE_LIST, 1))
    )
    return f"nullif(CASE {cases} END, '')"


def page_level(expr: str) -> str:
    return (
        f"CASE WHEN regexp_matches({expr}, '{fv.PAGE_MARKDOWN}') THEN length(regexp_extract({expr}, '{fv.PAGE_MARKDOWN}', 1))"
        f" WHEN regexp_matches({expr}, '{fv.PAGE_CHAPTER}') THEN CASE regexp_extract({expr}, '{fv.PAGE_CHAPTER}', 1) WHEN '章' THEN 1 ELSE 2 END"
        f" WHEN regexp_matches({expr}, '{fv.PAGE_DECIMAL}') THEN least(9, len(string_split(regexp_extract({expr}, '{fv.PAGE_DECIMAL}', 1), '.')))"
        f" WHEN regexp_matches({expr}, '{fv.PAGE_CHINESE_LIST}') THEN 1 END"
    )


def zero(column):
    """Rounded to six places, without a negative zero."""
    value = F.round(column, 6)
    return F.when(value == 0, 0.0).otherwise(value)


def _z(expr: str) -> str:
    return f"CASE WHEN round({expr}, 6) = 0 THEN 0.0::DOUBLE ELSE round({expr}, 6) END"


def runs(spark, sf_dir):
    return derive(spark, sf_dir, "text_runs")


def items(spark, sf_dir):
    return ly.with_flow_class(ly.with_dominant_flow(ly.layout_items(runs(spark, sf_dir))))


def lined(spark, sf_dir):
    return ly.with_lines(items(spark, sf_dir))


def segments(spark, sf_dir):
    return ly.segment_texts(items(spark, sf_dir))


def spaced(spark, sf_dir):
    return ly.with_spacing(segments(spark, sf_dir))


@entry(
    "src_text_items",
    ("text_runs",),
    "SELECT doc_id, page, item_index, text, t4 AS x, t5 AS y, width, has_eol FROM text_runs",
)
def src_text_items(spark, sf_dir):
    return runs(spark, sf_dir).select(
        "doc_id", "page", "item_index", "text", F.col("t4").alias("x"), F.col("t5").alias("y"), "width", "has_eol"
    )


_GEO = ("flow_x", "flow_y", "up_x", "up_y", "origin_x", "origin_y", "advance", "font_height", "ascent", "descent")
_GEO_SQL = ", ".join(f"{_z({'origin_x': 'ox', 'origin_y': 'oy'}.get(c, c))} AS {c}" for c in _GEO)


@entry(
    "pdf_item_geometry",
    ("run_geo",),
    f"SELECT doc_id, page, item_index, line_hint, structural, {_GEO_SQL} FROM run_geo",
)
def pdf_item_geometry(spark, sf_dir):
    return ly.item_geometry(runs(spark, sf_dir)).select(
        "doc_id", "page", "item_index", "line_hint", "structural", *[zero(F.col(c)).alias(c) for c in _GEO]
    )


@entry("pdf_bbox_normalize", ("run_box",), "SELECT doc_id, page, item_index, x, y, w AS width, h AS height FROM run_box")
def pdf_bbox_normalize(spark, sf_dir):
    return ly.with_region(ly.item_geometry(runs(spark, sf_dir))).select("doc_id", "page", "item_index", "region.*")


@entry("pdf_dominant_flow", ("run_pages",), f"SELECT doc_id, page, {_z('dx')} AS dx, {_z('dy')} AS dy FROM run_pages")
def pdf_dominant_flow(spark, sf_dir):
    pages = items(spark, sf_dir).filter("dominant_x IS NOT NULL").groupBy("doc_id", "page")
    return pages.agg(zero(F.first("dominant_x")).alias("dx"), zero(F.first("dominant_y")).alias("dy"))


@entry("pdf_flow_filter", ("run_flow",), "SELECT doc_id, page, item_index, in_flow FROM run_flow")
def pdf_flow_filter(spark, sf_dir):
    return items(spark, sf_dir).select("doc_id", "page", "item_index", "in_flow")


@entry("pdf_line_group", ("run_lines",), "SELECT doc_id, page, item_index, line_no FROM run_lines")
def pdf_line_group(spark, sf_dir):
    return lined(spark, sf_dir).select("doc_id", "page", "item_index", "line_no")


@entry(
    "pdf_segment_split",
    ("run_split",),
    "SELECT doc_id, page, item_index, line_no, segment_no, word_no FROM run_split",
)
def pdf_segment_split(spark, sf_dir):
    return ly.with_segments(lined(spark, sf_dir)).select(
        "doc_id", "page", "item_index", "line_no", "segment_no", "word_no"
    )


@entry(
    "pdf_segment_text",
    ("run_segments",),
    f"""SELECT doc_id, page, line_no, segment_no, text, CAST(items AS BIGINT) AS spans, {u16('text')} AS last_end, {_z('start')} AS start, {_z('finish')} AS "end" FROM run_segments""",
)
def pdf_segment_text(spark, sf_dir):
    return segments(spark, sf_dir).select(
        *ly.SEGMENT, "text", F.size("spans").alias("spans"), F.element_at("spans", -1)["text_end"].alias("last_end"),
        zero(F.col("start")).alias("start"), zero(F.col("end")).alias("end"),
    )


@entry(
    "pdf_bbox_union",
    ("run_segments",),
    f"""SELECT doc_id, page, line_no, segment_no, {_r6('x')} AS x, {_r6('y')} AS y, least({_r6('r - x')}, {_r6(f"1 - {_r6('x')}")}) AS width,
               least({_r6('b - y')}, {_r6(f"1 - {_r6('y')}")}) AS height FROM run_segments""",
)
def pdf_bbox_union(spark, sf_dir):
    boxes = F.transform("spans", lambda s: s["region"])
    return segments(spark, sf_dir).select(*ly.SEGMENT, ly.union_region(boxes).alias("box")).select(*ly.SEGMENT, "box.*")


@entry(
    "pdf_segment_font",
    ("run_segments",),
    "SELECT doc_id, page, line_no, segment_no, round(font_height, 6) AS font_height FROM run_segments",
)
def pdf_segment_font(spark, sf_dir):
    return segments(spark, sf_dir).select(*ly.SEGMENT, F.round("font_height", 6).alias("font_height"))


@entry("pdf_body_median", ("run_body",), "SELECT doc_id, page, round(body_font, 6) AS body_font FROM run_body")
def pdf_body_median(spark, sf_dir):
    return ly.body_font(items(spark, sf_dir)).select("doc_id", "page", F.round("body_font", 6).alias("body_font"))


@entry("pdf_line_spacing_median", ("run_typical",), "SELECT doc_id, page, round(typical, 6) AS typical FROM run_typical")
def pdf_line_spacing_median(spark, sf_dir):
    return ly.typical_spacing(spaced(spark, sf_dir)).select(
        "doc_id", "page", F.round("typical", 6).alias("typical")
    )


def judged(spark, sf_dir):
    return ly.with_spacing(ly.segment_texts(ly.with_body_font(items(spark, sf_dir))))


@entry("pdf_font_ranks", ("run_ranks",), "SELECT doc_id, page, bucket, rank FROM run_ranks")
def pdf_font_ranks(spark, sf_dir):
    return ly.font_ranks(judged(spark, sf_dir))


@entry(
    "pdf_explicit_heading",
    ("line_blocks",),
    f"""SELECT doc_id, line_no, CAST(level AS BIGINT) AS level, title FROM (SELECT doc_id, line_no, {page_level('line')} AS level, {page_title('line')} AS title FROM line_blocks)
        WHERE title IS NOT NULL""",
)
def pdf_explicit_heading(spark, sf_dir):
    rows = bl.line_blocks(canonical(spark, sf_dir)).select("doc_id", "line_no", page_heading(F.col("line")).alias("h"))
    return rows.filter("h IS NOT NULL").select("doc_id", "line_no", "h.level", "h.title")


@entry(
    "pdf_heading_classify",
    ("run_singles", "run_ranks"),
    f"""SELECT doc_id, page, line_no, CAST(CASE WHEN explicit IS NOT NULL THEN own_level ELSE rank END AS BIGINT) AS level, coalesce(explicit, {trim('text')}) AS title
        FROM (SELECT s.*, {page_title('text')} AS explicit, {page_level('text')} AS own_level, r.rank,
                     abs((start + finish) / 2 - (least(0, page_width * dx, page_height * dy, page_width * dx + page_height * dy) + greatest(0, page_width * dx, page_height * dy, page_width * dx + page_height * dy)) / 2)
                       <= 0.1 * (greatest(0, page_width * dx, page_height * dy, page_width * dx + page_height * dy) - least(0, page_width * dx, page_height * dy, page_width * dx + page_height * dy)) AS centred,
                     typical IS NOT NULL AND coalesce(before >= 1.25 * typical, true) AND coalesce(after >= 1.25 * typical, true) AS isolated
              FROM run_singles s LEFT JOIN run_ranks r ON r.doc_id = s.doc_id AND r.page = s.page AND r.bucket = s.bucket)
        WHERE (explicit IS NOT NULL)::INT + large::INT + (centred AND isolated)::INT >= 2 AND (explicit IS NOT NULL OR rank IS NOT NULL)""",
)
def pdf_heading_classify(spark, sf_dir):
    return ly.headings(judged(spark, sf_dir))


@entry(
    "pdf_table_bands",
    ("run_segments", "run_line_rows"),
    """SELECT doc_id, page, first_line, last_line FROM (
         SELECT doc_id, page, band, count(*) AS n, min(line_no) AS first_line, max(line_no) AS last_line, min(gap) AS tight, max(gap) AS loose
         FROM (SELECT *, CASE WHEN NOT changed THEN before END AS gap FROM banded) WHERE segments >= 2 GROUP BY ALL) b
       WHERE n >= 3 AND tight > 0 AND loose <= tight * 3 AND (SELECT bool_and(sound) FROM (
           SELECT drift <= tolerance AND coalesce(r < lead(l) OVER (ORDER BY segment_no), true) AS sound FROM (
             SELECT s.segment_no, max(s.start) - min(s.start) AS drift, min(s.start) AS l, max(s.finish) AS r, max(greatest(2 * scale, 0.01 * page_width)) AS tolerance
             FROM run_segments s WHERE s.doc_id = b.doc_id AND s.page = b.page AND s.line_no BETWEEN b.first_line AND b.last_line GROUP BY s.segment_no)))""".replace(
        "FROM banded",
        """FROM (SELECT *, sum(changed::INT) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS band FROM (
             SELECT *, coalesce(segments <> lag(segments) OVER (PARTITION BY doc_id, page ORDER BY line_no), true) AS changed FROM run_line_rows))""",
    ),
)
def pdf_table_bands(spark, sf_dir):
    return ly.table_bands(spaced(spark, sf_dir))


@entry("pdf_column_bands")
def pdf_column_bands(spark, sf_dir):
    return ly.column_bands(spaced(spark, sf_dir))


@entry("pdf_reading_order")
def pdf_reading_order(spark, sf_dir):
    drafts = ly.page_drafts(items(spark, sf_dir))
    return ly.reading_order(drafts).select("doc_id", "page", "draft_no", "kind", "text", "level", "title")


@entry("pdf_assemble")
def pdf_assemble(spark, sf_dir):
    return ly.extract_pages(runs(spark, sf_dir)).select(
        "doc_id", "block_no", "page", "kind", "text", "text_start", "text_end", "section_path", F.size("spans").alias("spans")
    )


@entry("req_extract_pdf")
def req_extract_pdf(spark, sf_dir):
    first = F.col("regions")[0]
    return rq.extract_pdf_requirements(runs(spark, sf_dir)).select(
        "doc_id", "code", "quote", "category", "priority", "confidence", "section_path", "quote_start", "quote_end",
        F.sha2("quote", 256).alias("quote_sha256"), F.size("regions").alias("regions"), "page",
        first["box"]["x"].alias("x"), first["box"]["y"].alias("y"), first["box"]["width"].alias("width"), first["box"]["height"].alias("height"),
    )


@entry(
    "pdf_rejects",
    ("text_runs",),
    """SELECT doc_id, items, 'DOCUMENT_RESOURCE_LIMIT_EXCEEDED' AS reject_reason FROM (SELECT doc_id, count(*) AS items FROM text_runs GROUP BY doc_id)
       WHERE items > (SELECT avg(n) FROM (SELECT count(*) AS n FROM text_runs GROUP BY doc_id))""",
)
def pdf_rejects(spark, sf_dir):
    # A limit that this data can pass: the mean number of runs of a document.
    every = runs(spark, sf_dir)
    mean = every.groupBy("doc_id").count().agg(F.avg("count")).first()[0] or 0
    return ly.within_item_limit(every, mean)[1].select("doc_id", "items", "reject_reason")


_HIDDEN = "doc_id, page, item_index, CASE WHEN length(doc_id) % 2 = 1 AND doc_id LIKE '%3' THEN '  ' ELSE text END AS text"


@entry(
    "pdf_needs_ocr",
    ("text_runs",),
    f"""SELECT DISTINCT doc_id, 'OCR_REQUIRED' AS reject_reason FROM text_runs t WHERE NOT EXISTS (
          SELECT 1 FROM (SELECT {_HIDDEN}, t4 FROM text_runs) h WHERE h.doc_id = t.doc_id AND NOT {blank('h.text')} AND h.t4 < 595)""",
)
def pdf_needs_ocr(spark, sf_dir):
    every = runs(spark, sf_dir)
    hidden = every.withColumn(
        "text", F.when((F.length("doc_id") % 2 == 1) & F.col("doc_id").like("%3"), "  ").otherwise(F.col("text"))
    )
    return ly.needs_ocr(every, ly.with_region(ly.item_geometry(hidden)))
