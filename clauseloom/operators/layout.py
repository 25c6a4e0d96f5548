"""Page-layout reconstruction on positioned text: geometry, lines, segments, bands, order, blocks.

Every step is keyed by (doc_id, page) and dealt by document. A page is bounded: documents beyond the span limit are failed
as a whole (``within_item_limit``) before any page is laid out. Per-row work is column arithmetic,
grouping is windows that share the document's partitioning: what is known of a line, band or page is a column of its rows, not a join. Python
folds the running means of lines (four numbers a run) and puts a segment's texts and boxes together, in one pass over sorted rows: a run is
shuffled once before it, a segment once behind it.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType

from clauseloom.functions import fixed_values as fv
from clauseloom.functions.signals import has_signal, page_heading
from clauseloom.functions.text import canonicalize, is_blank, pin, trim_ws, utf16_length

PAGE = ("doc_id", "page")
LINE = (*PAGE, "line_no")
SEGMENT = (*LINE, "segment_no")

# --- Fixed values: layout tolerances ------------------------------------------------------------
MAX_TILT = math.pi / 60
NEW_SEGMENT_EM, WORD_GAP_EM = 1.5, 0.2
LARGE_FONT, ISOLATION, CENTRE_SHARE = 1.25, 1.25, 0.1
TABLE_MIN_LINES, TABLE_SPACING_RATIO, ALIGN_SHARE = 3, 3.0, 0.01
BAND_MIN_LINES, BAND_SPLIT, GUTTER_SHARE, COLUMN_MIN = 6, 2.0, 0.05, 3
MAX_FONT_RANK = 9


def round6(value: Column) -> Column:
    return F.floor(value * 1_000_000 + 0.5) / 1_000_000


def within_item_limit(runs: DataFrame, limit: int = fv.LIMITS["spans"]) -> tuple[DataFrame, DataFrame]:
    """Runs of documents inside the limit, and the documents to fail. Nothing is truncated."""
    failed = (
        runs.groupBy("doc_id").agg(F.count("*").alias("items")).filter(F.col("items") > limit)
        .withColumn("reject_reason", F.lit("DOCUMENT_RESOURCE_LIMIT_EXCEEDED"))
    )
    return runs.join(failed.select("doc_id"), "doc_id", "left_anti"), failed


# --- items ----------------------------------------------------------------------------------------


def _placed(runs: DataFrame) -> DataFrame:
    """Geometry of runs where they are dealt by document, not sorted yet; blank runs, which only count for line hints, have none."""
    v, t = [F.col(f"v{i}") for i in range(6)], [F.col(f"t{i}") for i in range(6)]
    # Texts reach Python before the exchange: behind it, the windows of pages and documents follow each other without another one.
    # Runs are packed tenfold in a shuffle: as many tasks as it has, or a task would sort more of them than it has memory for.
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = runs.withColumns({"blank": is_blank(F.col("text")), "text": canonicalize(F.col("text"))}).repartition(parts, "doc_id")
    placed = pin(
        clean,
        m0=v[0] * t[0] + v[2] * t[1], m1=v[1] * t[0] + v[3] * t[1],
        m2=v[0] * t[2] + v[2] * t[3], m3=v[1] * t[2] + v[3] * t[3],
        origin_x=v[0] * t[4] + v[2] * t[5] + v[4], origin_y=v[1] * t[4] + v[3] * t[5] + v[5],
        scale=F.hypot(v[0], v[1]), flow_length=F.hypot(v[0] * t[0] + v[2] * t[1], v[1] * t[0] + v[3] * t[1]),
        font_height=F.hypot(v[0] * t[2] + v[2] * t[3], v[1] * t[2] + v[3] * t[3]),
    )
    metrics_ok = F.coalesce(
        (F.col("ascent") > 0) & (F.col("ascent") <= 2) & F.col("descent").between(-1, 0)
        & (F.col("ascent") - F.col("descent") <= 3),
        F.lit(False),
    )

    def shown(value: Column) -> Column:
        return F.when(~F.col("blank"), value)

    return placed.select(
        "doc_id", "page", "item_index", "text",
        shown(F.col("m0") / F.col("flow_length")).alias("flow_x"), shown(F.col("m1") / F.col("flow_length")).alias("flow_y"),
        shown(F.col("m2") / F.col("font_height")).alias("up_x"), shown(F.col("m3") / F.col("font_height")).alias("up_y"),
        "origin_x", "origin_y", (F.col("width") * F.col("scale")).alias("advance"), "font_height",
        F.when(metrics_ok, F.col("ascent")).otherwise(0.8).alias("ascent"),
        F.when(metrics_ok, F.col("descent")).otherwise(-0.2).alias("descent"),
        ((F.col("dir") == "ltr") & ~F.col("vertical")).alias("structural"),
        "scale", shown(F.col("page_width")).alias("page_width"), shown(F.col("page_height")).alias("page_height"), "blank", "has_eol",
    )


def _hinted(placed: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs that are not blank, with the line hint; with a ``limit``, of the documents inside it."""
    before = W.partitionBy(*PAGE).orderBy("item_index").rowsBetween(W.unboundedPreceding, -1)
    hinted = placed.withColumn("line_hint", F.coalesce(F.count_if("has_eol").over(before), F.lit(0).cast("long")))
    if limit is not None:
        # Counted where the runs lie, in the order that they are sorted in: an aggregate and a join would derive and shuffle all of them once more.
        document = W.partitionBy("doc_id").orderBy("page", "item_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        hinted = hinted.withColumn("items", F.count("*").over(document)).filter(F.col("items") <= limit).drop("items")
    return hinted.filter(~F.col("blank")).drop("blank", "has_eol")


def item_geometry(runs: DataFrame) -> DataFrame:
    """Unit vectors, advance, font height and line hint of each non-blank run, in viewport space."""
    return _hinted(_placed(runs))


def with_region(items: DataFrame) -> DataFrame:
    """``region``: the normalised, clipped box (top-left origin), NULL when nothing is visible."""

    def corners(origin: str, flow: str, up: str) -> Column:
        return F.array(
            *[
                F.col(origin) + F.col(flow) * along + F.col(up) * (F.col(edge) * F.col("font_height"))
                for along in (F.lit(0.0), F.col("advance"))
                for edge in ("descent", "ascent")
            ]
        )

    boxed = pin(items, xs=corners("origin_x", "flow_x", "up_x"), ys=corners("origin_y", "flow_y", "up_y"))
    zero, width, height = F.lit(0.0), F.col("page_width"), F.col("page_height")
    clipped = pin(
        boxed,
        left=F.greatest(zero, F.array_min("xs")), right=F.least(width, F.array_max("xs")),
        top=F.greatest(zero, F.array_min("ys")), bottom=F.least(height, F.array_max("ys")),
    )
    share = pin(
        clipped, x=round6(F.col("left") / width), y=round6(F.col("top") / height),
        w=round6((F.col("right") - F.col("left")) / width), h=round6((F.col("bottom") - F.col("top")) / height),
    )
    w, h = F.least("w", round6(1 - F.col("x"))), F.least("h", round6(1 - F.col("y")))
    visible = (F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top")) & (w > 0) & (h > 0)
    region = F.when(visible, F.struct("x", "y", w.alias("width"), h.alias("height")))
    return share.withColumn("region", region).drop(
        "xs", "ys", "left", "right", "top", "bottom", "x", "y", "w", "h"
    )


def is_combining() -> Column:
    """A zero-advance run of combining marks: no box of its own, but part of the text."""
    return (F.col("advance") == 0) & F.col("text").rlike(r"^\p{M}{1,64}\z")


def layout_items(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Visible runs and marks, with a ``limit`` of the documents inside it. Boxes come first, so that rows are sorted once, and narrow."""
    located = _hinted(with_region(_placed(runs)).drop("up_x", "up_y", "ascent", "descent"), limit)
    return located.filter(F.col("region").isNotNull() | is_combining())


def with_dominant_flow(items: DataFrame) -> DataFrame:
    """Adds the page's length-weighted axial mean direction (NULL without structural items)."""
    page = W.partitionBy(*PAGE)
    structural = F.col("structural")
    weight = F.when(structural, F.greatest(F.lit(1).cast("long"), utf16_length(F.col("text"))))
    angle = 2 * F.atan2("flow_y", "flow_x")
    summed = items.select(
        "*",
        F.sum(F.cos(angle) * weight).over(page).alias("cos_sum"),
        F.sum(F.sin(angle) * weight).over(page).alias("sin_sum"),
        F.sum(F.col("flow_x") * weight).over(page).alias("lean_x"),
        F.sum(F.col("flow_y") * weight).over(page).alias("lean_y"),
    )
    turned = pin(summed, axis=F.atan2("sin_sum", "cos_sum") / 2)
    along = F.cos("axis") * F.col("lean_x") + F.sin("axis") * F.col("lean_y")
    sign = F.when(along < 0, -1.0).otherwise(1.0)
    return turned.withColumns(
        {"dominant_x": sign * F.cos("axis"), "dominant_y": sign * F.sin("axis")}
    ).drop("cos_sum", "sin_sum", "lean_x", "lean_y", "axis")


def with_flow_class(items: DataFrame) -> DataFrame:
    """``in_flow``: structural and within 3 degrees of the dominant direction; the rest is emitted
    item by item."""
    along = F.least(
        F.lit(1.0), F.abs(F.col("flow_x") * F.col("dominant_x") + F.col("flow_y") * F.col("dominant_y"))
    )
    return items.withColumn(
        "in_flow", F.coalesce(F.col("structural") & (F.acos(along) <= MAX_TILT), F.lit(False))
    )


# --- lines ----------------------------------------------------------------------------------------


class _Lines:
    """Numbers of the lines of rows that arrive sorted by (page, coordinate, start, index).

    A line keeps its running mean and its tallest font; only that travels from row to row and from
    batch to batch.
    """

    def __init__(self):
        self.line, self.mean, self.tallest, self.hint, self.count = -1, 0.0, 0.0, None, 0

    def numbers(self, begins: np.ndarray, *columns: pa.Array) -> list[int]:
        """``begins`` is where a page does; then coordinate, font height, line hint and least tolerance."""
        line, mean, tallest, hint, count = self.line, self.mean, self.tallest, self.hint, self.count
        numbers = []
        for begin, across, font, row_hint, least in zip(begins.tolist(), *[c.to_pylist() for c in columns], strict=True):
            if begin:
                line, count, tallest = -1, 0, 0.0
            if count and row_hint == hint and abs(across - mean) <= max(least, 0.3 * max(font, tallest)):
                mean, count, tallest = (mean * count + across) / (count + 1), count + 1, max(tallest, font)
            else:
                line, mean, count, tallest, hint = line + 1, across, 1, font, row_hint
            numbers.append(line)
        self.line, self.mean, self.tallest, self.hint, self.count = line, mean, tallest, hint, count
        return numbers


@F.arrow_udf(LongType())
def _line_numbers(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Line numbers; ``at`` is 1 where a page begins."""
    lines = _Lines()
    for at, *columns in batches:
        yield pa.array(lines.numbers(at.to_numpy() == 1, *columns), pa.int64())


def with_projection(items: DataFrame) -> DataFrame:
    """Position along (``start``, ``end``) and across (``coordinate``) the dominant direction."""
    along = F.col("origin_x") * F.col("dominant_x") + F.col("origin_y") * F.col("dominant_y")
    across = F.col("origin_y") * F.col("dominant_x") - F.col("origin_x") * F.col("dominant_y")
    length = F.col("advance") * F.abs(
        F.col("flow_x") * F.col("dominant_x") + F.col("flow_y") * F.col("dominant_y")
    )
    return items.withColumns({"start": along, "end": along + length, "coordinate": across})


def with_lines(items: DataFrame) -> DataFrame:
    """In-flow items with ``line_no`` (0-based per page)."""
    flowing = with_projection(items.filter("in_flow"))
    # The window sorts the rows of a page; Spark hands them to Python in that order.
    order = W.partitionBy(*PAGE).orderBy("coordinate", "start", "item_index")
    number = _line_numbers.asNondeterministic()("at", "coordinate", "font_height", "line_hint", F.col("scale") * 2)
    return flowing.withColumn("at", F.row_number().over(order)).withColumn("line_no", number).drop("at")


# --- segments -------------------------------------------------------------------------------------


def _gaps(lined: DataFrame) -> DataFrame:
    """``breaks`` where a run begins a segment within its line, ``spaced`` where it begins a word within its segment."""
    order = W.partitionBy(*PAGE).orderBy("line_no", "start", "item_index")
    own = F.lag("line_no").over(order) == F.col("line_no")
    em = F.greatest(F.lit(1.0), (F.col("font_height") + F.lag("font_height").over(order)) / 2)
    gap = F.when(own, F.col("start") - F.lag("end").over(order))
    gaps = lined.select("*", gap.alias("gap"), em.alias("em"))
    breaks = F.coalesce(F.col("gap") > NEW_SEGMENT_EM * F.col("em"), F.lit(False))
    spaced = F.coalesce(F.col("gap") >= WORD_GAP_EM * F.col("em"), F.lit(False))
    return gaps.select("*", breaks.alias("breaks"), (~breaks & spaced).alias("spaced"))


def with_segments(lined: DataFrame) -> DataFrame:
    """``segment_no`` inside the line and ``word_no`` (runs that touch) inside the segment."""
    upto = W.partitionBy(*LINE).orderBy("start", "item_index").rowsBetween(W.unboundedPreceding, 0)
    numbered = _gaps(lined).select(
        "*", F.count_if("breaks").over(upto).alias("segment_no"), F.count_if(F.col("breaks") | F.col("spaced")).over(upto).alias("word_no")
    )
    return numbered.drop("gap", "em", "breaks", "spaced")


def union_region(regions: Column) -> Column:
    """Smallest box around boxes of one page."""
    def edge(name: str, size: str | None, pick) -> Column:
        return pick(F.transform(regions, lambda r: r[name] if size is None else r[name] + r[size]))

    x, y = round6(edge("x", None, F.array_min)), round6(edge("y", None, F.array_min))
    right, bottom = edge("x", "width", F.array_max), edge("y", "height", F.array_max)
    left, top = edge("x", None, F.array_min), edge("y", None, F.array_min)
    return F.struct(
        x.alias("x"), y.alias("y"), F.least(round6(right - left), round6(1 - x)).alias("width"),
        F.least(round6(bottom - top), round6(1 - y)).alias("height"),
    )


SPANS = pa.list_(pa.struct([
    ("text_start", pa.int64()), ("text_end", pa.int64()),
    ("region", pa.struct([(n, pa.float64()) for n in ("x", "y", "width", "height")])),
]))
_BOX = ("x", "y", "width", "height")
BOX = f"struct<{','.join(f'{n}:double' for n in _BOX)}>"


def _round6(value: float) -> float:
    return math.floor(value * 1_000_000 + 0.5) / 1_000_000


def _union(boxes: list[list[float]]) -> tuple[float, ...]:
    """``union_region`` of a group's boxes."""
    left, top = min(b[0] for b in boxes), min(b[1] for b in boxes)
    right, bottom = max(b[0] + b[2] for b in boxes), max(b[1] + b[3] for b in boxes)
    x, y = _round6(left), _round6(top)
    return x, y, min(_round6(right - left), _round6(1 - x)), min(_round6(bottom - top), _round6(1 - y))


def _joined(rows: pa.RecordBatch, kept: list[str]) -> pa.RecordBatch:
    """Whole segments of runs (``begins`` at their first, ``parted`` at the first of a word) → one row each."""
    begins, parts = (np.array(rows.column(n), bool) for n in ("begins", "parted"))
    first, word_first = np.flatnonzero(begins), np.flatnonzero(parts)
    word = np.cumsum(parts) - 1
    ends = np.append(word_first[1:], len(word))
    region = rows.column("region")
    seen = np.array(region.is_valid())
    box = np.stack([np.nan_to_num(np.array(region.field(n).fill_null(0.0), float)) for n in _BOX], 1)
    # A mark without a box counts only after a visible run of its word.
    count = np.cumsum(seen)
    usable = seen | (count > (count - seen)[word_first][word])
    units = np.array(rows.column("units"), np.int64)
    length = np.add.reduceat(np.where(usable, units, 0), word_first)
    uses = np.add.reduceat(usable.astype(np.int64), word_first)
    texts = rows.column("text").to_pylist()
    # A word of one run is that run; the others are normalised as one text.
    lead = np.minimum(np.maximum.reduceat(np.where(usable, np.arange(len(word)), -1), word_first), len(word) - 1)
    made = [texts[i] for i in lead.tolist()]
    merged = {}
    for w in np.flatnonzero(uses > 1).tolist():
        own = [i for i in range(word_first[w], ends[w]) if usable[i]]
        raw = "".join([texts[i] for i in own])
        made[w] = raw if raw.isascii() else unicodedata.normalize("NFC", raw)
        if made[w] != raw or not seen[own].all():
            length[w] = len(made[w].encode("utf-16-le")) // 2
            merged[w] = own[0], _union([box[i].tolist() for i in own if seen[i]])
    full = (uses > 0) & (length > 0)
    segment_of = (np.cumsum(begins) - 1)[word_first]
    # Words follow each other with one space between, spans of a word without.
    at = np.cumsum(np.where(full, length + 1, 0)) - np.where(full, length + 1, 0)
    head = np.searchsorted(segment_of, np.arange(len(first)))
    at -= at[head][segment_of]
    within = np.cumsum(np.where(usable, units, 0)) - np.where(usable, units, 0)
    span_start = at[word] + within - within[word_first][word]
    span_end = span_start + units
    shown = seen & full[word]
    for w, (i, union) in merged.items():
        shown[word_first[w] : ends[w]] = False
        shown[i], span_start[i], span_end[i], box[i] = full[w], at[w], at[w] + length[w], union
    words = np.add.reduceat(full.astype(np.int64), head)
    text = [made[w] for w in head.tolist()]
    for s in np.flatnonzero((words != 1) | (np.diff(np.append(head, len(made))) > 1)).tolist():
        last = head[s + 1] if s + 1 < len(head) else len(made)
        text[s] = " ".join([made[w] for w in range(head[s], last) if full[w]])
    stays = words > 0
    sizes = np.add.reduceat(shown.astype(np.int64), first)[stays]
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    regions = pa.StructArray.from_arrays([pa.array(box[shown, k]) for k in range(4)], list(_BOX))
    inner = pa.StructArray.from_arrays([pa.array(span_start[shown]), pa.array(span_end[shown]), regions], ["text_start", "text_end", "region"])
    picked = pa.array(first[stays])
    final = np.append(first[1:], len(word))[stays] - 1
    fonts = np.add.reduceat(np.array(rows.column("font_height"), float) * units, first)
    weights = np.add.reduceat(units, first)
    columns = [rows.column(n).take(picked) for n in kept]
    columns += [
        pa.array([t for t, stay in zip(text, stays.tolist(), strict=True) if stay], pa.string()), pa.ListArray.from_arrays(pa.array(offsets), inner).cast(SPANS),
        rows.column("end").take(pa.array(final)), pa.array((fonts / weights)[stays]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "spans", "end", "font_height"])


def _above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a > b`` as columns compare: NaN is above all numbers."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _parted(rows: pa.RecordBatch, line: np.ndarray) -> pa.RecordBatch:
    """Rows of whole lines in reading order, with the mean coordinate of their ``line`` and where segments (``begins``) and words (``parted``)
    begin: ``_gaps`` of the runs of a page."""
    number = {n: np.array(rows.column(n).cast(pa.float64()).fill_null(np.nan), float) for n in ("start", "end", "font_height", "coordinate")}
    order = np.lexsort((np.array(rows.column("item_index")), number["start"], line))
    rows, line, number = rows.take(pa.array(order)), line[order], {n: v[order] for n, v in number.items()}
    first = np.append(True, line[1:] != line[:-1])
    ended, font = np.roll(number["end"], 1), number["font_height"]
    em = np.maximum(1.0, (font + np.roll(font, 1)) / 2)
    gap = number["start"] - ended
    unknown = first | np.roll(np.array(rows.column("end").is_null()), 1)
    begins = unknown | _above(gap, NEW_SEGMENT_EM * em)
    words = begins | ~_above(WORD_GAP_EM * em, gap)
    place = np.cumsum(first) - 1
    mean = np.bincount(place, weights=number["coordinate"]) / np.bincount(place)
    for name, values in (("line", line), ("line_coordinate", mean[place]), ("begins", begins), ("parted", words)):
        rows = rows.append_column(name, pa.array(values))
    return rows


class _Numbers:
    """Lines of a page and segments of a line numbered without gaps: lines that lost all of their text don't count."""

    def __init__(self):
        self.page, self.lines = -1, 0

    def numbered(self, made: pa.RecordBatch) -> pa.RecordBatch:
        page, line = np.array(made.column("at_page")), np.array(made.column("line"))
        rank = np.zeros(0, np.int64)
        segment = rank
        if len(line):
            new_page = np.append(True, page[1:] != page[:-1])
            new_line = new_page | np.append(True, line[1:] != line[:-1])
            count = np.cumsum(new_line) - 1
            group = np.cumsum(new_page) - 1
            rank = count - count[new_page][group]
            if page[0] == self.page:
                rank = rank + np.where(group == 0, self.lines, 0)
            segment = np.arange(len(line)) - np.flatnonzero(new_line)[count]
            self.page, self.lines = page[-1], rank[-1] + 1
        return made.append_column("line_no", pa.array(rank, pa.int64())).append_column("segment_no", pa.array(segment, pa.int64()))


_CARRIED = ("start", "line_coordinate", "page_width", "page_height", "scale", "dominant_x", "dominant_y", "body_font", "zone", "item_index")


def segment_texts(items: DataFrame, loose: bool = False) -> DataFrame:
    """One row per segment: text, spans with boxes, extent, mean font height, line coordinate (and ``body_font``, where ``items`` have it).

    ``items`` are classified, with or without ``line_no``. Touching runs form a word group whose text is normalised as one. When that changes it, or when a
    mark without a box joins in, the group gets one span around all of its boxes. With ``loose``, visible items outside the dominant
    direction come out, too, each as it is: their ``zone`` is 1 and they are lines of their own behind the others of their page.
    """
    lined = "line_no" in items.columns
    rows = items if lined else with_projection(items if loose else items.filter("in_flow"))
    if loose:
        # A page without a direction has no coordinates.
        seen = rows.filter(F.col("in_flow") | F.col("region").isNotNull()).withColumn("zone", F.when(F.col("in_flow"), 0).otherwise(1))
        rows = seen.withColumn("coordinate", F.when(F.col("in_flow"), F.col("coordinate")).otherwise(0.0))
    # The window sorts the rows of a page; Spark hands them to Python in that order.
    order = W.partitionBy(*PAGE).orderBy(*["zone"][: int(loose)], "line_no" if lined else "coordinate", "start", "item_index")
    carried = [*PAGE, *[c for c in _CARRIED if c in rows.columns and (loose or c != "item_index")]]
    sent = rows.select(
        *carried, *[c for c in ("item_index",) if c not in carried], "coordinate", "end", "text", "region", "font_height",
        utf16_length(F.col("text")).alias("units"), *(["line_no"] if lined else ["line_hint", (F.col("scale") * 2).alias("least")]),
        F.row_number().over(order).alias("at"),
    )
    kept = [*carried[:2], "line_coordinate", *carried[2:], "line", "at_page"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, numbers, pages, lines, last = _Lines(), _Numbers(), 0, 0, -1
        # An unfinished line waits for its other runs. Lines are numbered anew for each page, so a page's number goes with them.
        waiting: list[tuple[pa.RecordBatch, np.ndarray]] = []

        def finished() -> Iterator[pa.RecordBatch]:
            rows = pa.concat_batches([b for b, _ in waiting]) if waiting else None
            if rows is not None and rows.num_rows:
                made = _joined(_parted(rows, np.concatenate([n for _, n in waiting])), kept)
                yield numbers.numbered(made).drop_columns(["line", "at_page"])

        for batch in batches:
            begins = np.array(batch.column("at")) == 1
            page = pages + np.cumsum(begins)
            pages = int(page[-1]) if len(page) else pages
            own = np.array(batch.column("line_no") if lined else fold.numbers(begins, *[batch.column(n) for n in ("coordinate", "font_height", "line_hint", "least")]))
            apart = np.array(batch.column("zone")) == 1 if loose else np.zeros(len(begins), bool)
            before = np.append(last, own[:-1])
            opens = begins | apart | (own != before)
            if not len(opens):
                continue
            last = own[-1]
            line = lines + np.cumsum(opens)
            lines = int(line[-1])
            batch = batch.append_column("at_page", pa.array(page, pa.int64()))
            starts = np.flatnonzero(opens)
            if not len(starts):
                waiting.append((batch, line))
                continue
            waiting.append((batch.slice(0, starts[-1]), line[: starts[-1]]))
            yield from finished()
            waiting[:] = [(batch.slice(starts[-1]), line[starts[-1] :])]
        yield from finished()

    types = {f.name: f.dataType.simpleString() for f in sent.schema}
    kinds = ", ".join(f"{c} {types.get(c, 'double')}" for c in kept[:-2])
    return sent.mapInArrow(
        join, f"{kinds}, text string, spans array<struct<text_start:bigint,text_end:bigint,region:{BOX}>>, end double, font_height double, "
        "line_no bigint, segment_no bigint",
    )


# --- page statistics ------------------------------------------------------------------------------


def with_body_font(items: DataFrame) -> DataFrame:
    """``body_font``: the page's length-weighted lower median font height of in-flow items; NULL below two samples."""
    page = W.partitionBy(*PAGE)
    order = page.orderBy("font_height")
    flowing = F.col("in_flow")
    summed = items.withColumn("weight", F.when(flowing, utf16_length(F.col("text")))).select(
        "*", F.sum("weight").over(order.rangeBetween(W.unboundedPreceding, 0)).alias("upto"),
        F.sum("weight").over(page).alias("total"), F.count_if(flowing).over(page).alias("samples"),
    )
    middle = F.when(flowing & (F.col("upto") * 2 >= F.col("total")), F.col("font_height"))
    return summed.withColumn("body_font", F.when(F.col("samples") >= 2, F.min(middle).over(page))).drop("weight", "upto", "total", "samples")


def body_font(items: DataFrame) -> DataFrame:
    """``body_font`` of each page with in-flow items."""
    return with_body_font(items).filter("in_flow").groupBy(*PAGE).agg(F.first("body_font").alias("body_font"))


def _page_of(segments: DataFrame) -> list[str]:
    """What keys the lines of a page: items outside the dominant direction (``zone`` 1) are none."""
    return [*PAGE, *[c for c in ("zone",) if c in segments.columns]]


def _line_of(segments: DataFrame) -> list[str]:
    return [*_page_of(segments), "line_no"]


def with_spacing(segments: DataFrame) -> DataFrame:
    """Of each segment's line: number of ``segments``, where it starts, spacing to its neighbours (``before``, ``after``); of its page: the exact median
    of the positive spacings (``typical``)."""
    page = W.partitionBy(*_page_of(segments))
    order, at = page.orderBy("line_no"), F.col("line_coordinate")
    # Lines are numbered without gaps, so a neighbour is one number away.
    spaced = segments.repartition("doc_id").select(
        "*", (at - F.first(at).over(order.rangeBetween(-1, -1))).alias("before"),
        (F.first(at).over(order.rangeBetween(1, 1)) - at).alias("after"), F.count("*").over(W.partitionBy(*_line_of(segments))).alias("segments"),
        F.min("start").over(W.partitionBy(*_line_of(segments))).alias("line_start"),
    )
    positive = F.when((F.col("segment_no") == 0) & (F.col("before") > 0), F.col("before"))
    return spaced.withColumn("typical", F.median(positive).over(page))


def typical_spacing(spaced: DataFrame) -> DataFrame:
    return spaced.groupBy(*PAGE).agg(F.first("typical").alias("typical"))


def _heading_text() -> Column:
    text = F.col("text")
    return (
        (utf16_length(text) <= fv.HEADING_MAX_UNITS) & (F.length(text) > 0) & ~has_signal(text)
        & ~text.rlike(fv.PAGE_TRAILING_MARK)
    )


def font_bucket() -> Column:
    """Font height in quarter points of the unscaled page."""
    unscaled = F.when(F.col("scale") > 0, F.col("font_height") / F.col("scale")).otherwise(F.col("font_height"))
    return F.floor(unscaled * 4 + 0.5) / 4


def _large() -> Column:
    return F.coalesce((F.col("body_font") > 0) & (F.col("font_height") >= LARGE_FONT * F.col("body_font")), F.lit(False))


def with_marks(spaced: DataFrame) -> DataFrame:
    """Adds to lines of one segment what may make them headings (``large``, ``placed``, ``fits``, ``explicit``) and the ``bucket`` of candidate sizes.

    A heading has two of: explicit form, large font, centred and isolated. Without the last two it has one at most, so the
    patterns are tried on the other lines only.
    """
    corners = [
        F.lit(0.0), F.col("page_width") * F.col("dominant_x"), F.col("page_height") * F.col("dominant_y"),
        F.col("page_width") * F.col("dominant_x") + F.col("page_height") * F.col("dominant_y"),
    ]
    low, high = F.least(*corners), F.greatest(*corners)
    extent = high - low
    centred = (extent > 0) & (F.abs((F.col("start") + F.col("end")) / 2 - (low + high) / 2) <= CENTRE_SHARE * extent)
    wide = ISOLATION * F.col("typical")
    # The page edge counts as unlimited space.
    isolated = F.col("typical").isNotNull() & F.coalesce(F.col("before") >= wide, F.lit(True)) & F.coalesce(
        F.col("after") >= wide, F.lit(True)
    )
    judged = pin(spaced, large=_large(), placed=F.coalesce(centred & isolated, F.lit(False)))
    alone = (F.col("segments") == 1) & (F.col("large") | F.col("placed"))
    fit = pin(judged, fits=F.when(alone, _heading_text()).otherwise(False))
    return pin(
        fit, explicit=F.when(F.col("fits"), page_heading(F.col("text"))),
        bucket=F.when(F.col("fits") & F.col("large"), font_bucket()),
    )


def with_levels(marked: DataFrame) -> DataFrame:
    """Adds to marked lines their ``heading`` (level, title) and the ``rank`` of candidate sizes, largest first, at most nine ranks."""
    # A page has few sizes, in quarter points: a rank counts the larger ones, and nothing is sorted for it.
    sizes = marked.withColumn("sizes", F.collect_set("bucket").over(W.partitionBy(*_page_of(marked))))
    rank = F.size(F.filter("sizes", lambda size: size > F.col("bucket"))) + 1
    ranked = sizes.withColumn("rank", F.when(F.col("bucket").isNotNull(), F.least(rank, F.lit(MAX_FONT_RANK)).cast("long"))).drop("sizes")
    signals = F.col("large").cast("int") + F.col("placed").cast("int") + F.col("explicit").isNotNull().cast("int")
    plain = F.when(
        F.col("rank").isNotNull() & ~is_blank(F.col("text")),
        F.struct(F.col("rank").cast("int").alias("level"), trim_ws(F.col("text")).alias("title")),
    )
    heading = F.when(F.col("fits") & (signals >= 2), F.coalesce("explicit", plain))
    return ranked.withColumn("heading", heading).drop("large", "placed", "fits", "explicit")


def with_headings(spaced: DataFrame) -> DataFrame:
    """Adds ``heading``, ``bucket`` and ``rank`` to lines."""
    return with_levels(with_marks(spaced))


def font_ranks(spaced: DataFrame) -> DataFrame:
    """Candidate heading sizes of a page with their ranks."""
    return with_headings(spaced).filter("bucket IS NOT NULL").groupBy(*PAGE, "bucket").agg(F.first("rank").alias("rank"))


def headings(spaced: DataFrame) -> DataFrame:
    found = with_headings(spaced).filter("heading IS NOT NULL")
    return found.select(*LINE, F.col("heading.level").cast("long").alias("level"), F.col("heading.title").alias("title"))


# --- bands ----------------------------------------------------------------------------------------


def _earlier_lines(segments: DataFrame) -> W:
    """Lines of a page up to the row's own."""
    return W.partitionBy(*_page_of(segments)).orderBy("line_no").rangeBetween(W.unboundedPreceding, 0)


def with_bands(spaced: DataFrame) -> DataFrame:
    """Numbers of the bands of lines that may be a table (``table_band``) or columns (``column_band``), both while lines are in order."""
    lines = W.partitionBy(*_page_of(spaced)).orderBy("line_no")
    opens = F.col("segment_no") == 0
    changed = F.coalesce(F.col("segments") != F.first("segments").over(lines.rangeBetween(-1, -1)), F.lit(True))
    split = F.coalesce(F.col("before") >= BAND_SPLIT * F.col("typical"), F.lit(False)) & opens
    upto, flagged = _earlier_lines(spaced), spaced.withColumn("changed", changed)
    return flagged.select(
        "*", F.count_if(F.col("changed") & opens).over(upto).alias("table_band"), F.count_if(split).over(upto).alias("column_band"),
    )


def with_tables(spaced: DataFrame) -> DataFrame:
    """``in_table``, and the table's ``first_line`` and ``last_line``: three or more neighbours with the same columns, aligned and disjoint."""
    banded = spaced if "table_band" in spaced.columns else with_bands(spaced).drop("column_band")
    page = _page_of(spaced)
    band, cell = W.partitionBy(*page, "table_band"), W.partitionBy(*page, "table_band", "segment_no")
    cells = banded.select(
        "*", F.min("start").over(cell).alias("left_edge"), F.max("end").over(cell).alias("right_edge"),
        (F.max("start").over(cell) - F.min("start").over(cell)).alias("drift"),
        F.max(F.greatest(2 * F.col("scale"), ALIGN_SHARE * F.col("page_width"))).over(cell).alias("tolerance"),
    )
    right_of = F.first("left_edge").over(band.orderBy("segment_no").rangeBetween(1, 1))
    judged = cells.withColumn(
        "sound", (F.col("drift") <= F.col("tolerance")) & F.coalesce(F.col("right_edge") < right_of, F.lit(True))
    )
    gap = F.when(~F.col("changed"), F.col("before"))
    rows = judged.select(
        "*", F.count_if(F.col("segment_no") == 0).over(band).alias("n"), F.min("line_no").over(band).alias("first_line"),
        F.max("line_no").over(band).alias("last_line"), F.min(gap).over(band).alias("tight"), F.max(gap).over(band).alias("loose"),
        F.bool_and("sound").over(band).alias("all_sound"),
    )
    stable = (
        (F.col("segments") >= 2) & (F.col("n") >= TABLE_MIN_LINES) & (F.col("tight") > 0)
        & (F.col("loose") <= TABLE_SPACING_RATIO * F.col("tight")) & F.col("all_sound")
    )
    return rows.withColumn("in_table", F.coalesce(stable, F.lit(False))).drop(
        "changed", "table_band", "left_edge", "right_edge", "drift", "tolerance", "sound", "n", "tight", "loose", "all_sound"
    )


def table_bands(spaced: DataFrame) -> DataFrame:
    """First and last lines of stable tables."""
    return with_tables(spaced).filter("in_table").select(*PAGE, "first_line", "last_line").distinct()


def with_columns(spaced: DataFrame) -> DataFrame:
    """Of segments in stable two-column bands: ``side`` (0 left, 1 right) and ``band_line``, the band's first line; else both NULL."""
    banded = spaced if "column_band" in spaced.columns else with_bands(spaced).drop("changed", "table_band")
    band = W.partitionBy(*_page_of(spaced), "column_band")
    by_start = band.orderBy("start", "line_no")
    gapped = banded.select(
        "*", (F.col("start") - F.lag("start").over(by_start)).alias("gap"), F.row_number().over(by_start).alias("at")
    )
    # The first largest positive gap between sorted starts separates the columns.
    widest = F.max(F.when(F.col("gap") > 0, F.struct("gap", (-F.col("at")).alias("before_at"), "start"))).over(band)
    parted = gapped.select(
        "*", widest["start"].alias("split_start"), F.min("line_no").over(band).alias("first_of_band"),
        F.count_if(F.col("segment_no") == 0).over(band).alias("band_lines"),
    )
    # What is behind the gap starts behind all that is before it; a line is crossed where a segment is not on the side of the first one.
    behind, began = F.col("start") >= F.col("split_start"), F.col("line_start") >= F.col("split_start")
    sided = parted.withColumns({"half": behind.cast("int"), "crossed": behind != began})
    left, right = F.col("half") == 0, F.col("half") == 1

    def stat(fn, side: Column, column: str) -> Column:
        return fn(F.when(side, F.col(column))).over(band)

    opens = F.col("segment_no") == 0
    extent = F.abs(F.col("dominant_x")) * F.col("page_width") + F.abs(F.col("dominant_y")) * F.col("page_height")
    stats = sided.select(
        "*", F.bool_or("crossed").over(band).alias("any_crossed"),
        # Where no line has both sides, a line is on the side of its first segment.
        F.count_if(left & opens).over(band).alias("lines_left"), F.count_if(right & opens).over(band).alias("lines_right"),
        (stat(F.min, right, "start") - stat(F.max, left, "end")).alias("gutter"),
        (stat(F.max, left, "start") - stat(F.min, left, "start")).alias("drift_left"),
        (stat(F.max, right, "start") - stat(F.min, right, "start")).alias("drift_right"),
        F.greatest(stat(F.min, left, "line_coordinate"), stat(F.min, right, "line_coordinate")).alias("top"),
        F.least(stat(F.max, left, "line_coordinate"), stat(F.max, right, "line_coordinate")).alias("bottom"),
        F.max(extent).over(band).alias("extent"), F.max("scale").over(band).alias("band_scale"),
    )
    tolerance = F.greatest(2 * F.col("band_scale"), ALIGN_SHARE * F.col("extent"))
    stable = F.coalesce(
        (F.col("band_lines") >= BAND_MIN_LINES) & F.col("split_start").isNotNull() & ~F.col("any_crossed")
        & (F.least("lines_left", "lines_right") >= COLUMN_MIN) & (F.col("gutter") > GUTTER_SHARE * F.col("extent"))
        & (F.greatest("drift_left", "drift_right") <= tolerance) & (F.col("top") <= F.col("bottom")),
        F.lit(False),
    )
    return stats.select(
        *[c for c in spaced.columns if c != "column_band"], F.when(stable, F.col("first_of_band")).alias("band_line"), F.when(stable, F.col("half")).alias("side")
    )


def column_bands(spaced: DataFrame) -> DataFrame:
    """Segments of stable two-column bands."""
    return with_columns(spaced).filter("side IS NOT NULL").select(*SEGMENT, "band_line", "side")


# --- order and assembly ---------------------------------------------------------------------------


def page_drafts(items: DataFrame) -> DataFrame:
    """Ordered block drafts of every page: kind, text, spans, heading level and title.

    ``items`` are classified layout items. Tables win over columns, columns over plain lines; items
    outside the dominant direction follow the page one by one.
    """
    segments = segment_texts(with_body_font(items), loose=True)
    # Rows are sorted by line, by table and by column; marks, behind which no order is known, lie between the first two.
    judged = with_levels(with_columns(with_tables(with_marks(with_bands(with_spacing(segments))))))
    joined = judged.withColumn("tabled", F.bool_or("in_table").over(W.partitionBy(*_page_of(judged))))
    flows = F.col("zone") == 0
    in_table, in_column = flows & F.col("in_table"), flows & F.col("side").isNotNull() & ~F.col("tabled")
    heading = flows & ~in_table & ~in_column & F.col("heading").isNotNull()
    zero = F.lit(0).cast("long")
    return joined.select(
        *PAGE, "zone", F.when(~flows, F.col("item_index")).when(in_column, F.col("band_line")).otherwise(F.col("line_no")).alias("row_at"),
        F.when(in_column, F.col("side").cast("long")).otherwise(zero).alias("side"), F.when(flows, F.col("line_no")).otherwise(zero).alias("line_at"),
        F.when(flows, F.col("segment_no")).otherwise(zero).alias("part_at"),
        F.when(in_table, "table-cell").when(heading, "heading").otherwise("paragraph").alias("kind"),
        "text", "spans", F.when(heading, F.col("heading.level").cast("long")).alias("level"),
        F.when(heading, F.col("heading.title")).alias("title"),
    )


ORDER = ("page", "zone", "row_at", "side", "line_at", "part_at")


def reading_order(drafts: DataFrame) -> DataFrame:
    """``draft_no`` inside the page."""
    order = W.partitionBy(*PAGE).orderBy(*ORDER[1:])
    return drafts.withColumn("draft_no", F.row_number().over(order).cast("long"))


DEEPEST = 9


def with_paths(blocks: DataFrame, *order: str) -> DataFrame:
    """``section_path`` of a document's blocks in this order, by the levels and titles of their headings.

    A heading cuts the path to the titles above its level, if that is at most one below the depth so far, and adds its own. So the depth behind the
    k-th heading is the least of k and of ``level + k - j`` of all headings j so far, and a path has, for each depth up to that, the latest title there.
    """
    upto = W.partitionBy("doc_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    heading = F.col("level").isNotNull()
    counted = blocks.withColumn("heading_no", F.count_if(heading).over(upto))
    level = F.least(F.greatest("level", F.lit(1)), F.lit(DEEPEST))
    lowest = counted.withColumn("lowest", F.min(F.when(heading, level - F.col("heading_no"))).over(upto))
    placed = lowest.withColumn("depth", F.when(heading, F.col("heading_no") + F.least(F.lit(0), "lowest")))
    latest = placed.select(
        *blocks.columns, F.last("depth", True).over(upto).alias("depth"),
        *[F.last(F.when(F.col("depth") == d, F.struct("title")), True).over(upto).alias(f"at_{d}") for d in range(1, DEEPEST + 1)],
    )
    path = F.slice(F.array(*[F.col(f"at_{d}.title") for d in range(1, DEEPEST + 1)]), F.lit(1), F.coalesce(F.col("depth"), F.lit(0)).cast("int"))
    return latest.select(*blocks.columns, path.alias("section_path"))


def assemble(drafts: DataFrame) -> DataFrame:
    """Document blocks: pages in order, texts joined by one LF, running offsets, section paths."""
    keys = (*ORDER, "kind", "text")
    order = W.partitionBy("doc_id").orderBy(*keys)
    units = utf16_length(F.col("text"))
    before = F.sum(units + 1).over(order.rowsBetween(W.unboundedPreceding, -1))
    placed = drafts.filter(F.length("text") > 0).select(
        "*", F.row_number().over(order).cast("long").alias("block_no"), F.coalesce(before, F.lit(0).cast("long")).alias("text_start"),
    )
    spans = F.transform(
        "spans",
        lambda s: F.struct(
            (F.col("text_start") + s["text_start"]).alias("text_start"), (F.col("text_start") + s["text_end"]).alias("text_end"), s["region"].alias("region"),
        ),
    )
    return with_paths(placed, *keys).select(
        "doc_id", "block_no", "page", "kind", "text", "text_start", (F.col("text_start") + units).alias("text_end"), "section_path", spans.alias("spans"),
    )


def extract_pages(runs: DataFrame) -> DataFrame:
    """Positioned runs → blocks of the documents inside the item limit; ``within_item_limit`` returns the others."""
    return assemble(page_drafts(with_flow_class(with_dominant_flow(layout_items(runs, fv.LIMITS["spans"])))))


def needs_ocr(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without any locatable text."""
    located = items.filter(F.col("region").isNotNull()).select("doc_id").distinct()
    return documents.select("doc_id").distinct().join(located, "doc_id", "left_anti").withColumn(
        "reject_reason", F.lit("OCR_REQUIRED")
    )
