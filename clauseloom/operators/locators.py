"""Source evidence: positions, span overlap, locators and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clauseloom.functions import fixed_values as fv
from clauseloom.functions.text import canonicalize, let, running_starts, utf16_length
from clauseloom.operators.quality import extension_of, first_reason


def _all_line_starts(text: Column) -> Column:
    """array<long>: UTF-16 offset of every physical line, blank ones included."""
    return running_starts(F.transform(F.split(text, "\n", -1), lambda line: utf16_length(line) + 1))


def line_starts(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(_all_line_starts(F.col("text"))).alias("i", "line_start"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), "line_start")


def positions_at(docs: DataFrame, offsets: DataFrame) -> DataFrame:
    """``offsets(doc_id, offset)`` → 1-based line and 0-based UTF-16 column.

    An as-of lookup: line starts and offsets are merged by position and the latest start is carried
    forward. Only positions are shuffled, never text, and no offset is paired with every line.
    """
    starts = line_starts(docs).select(
        "doc_id", F.col("line_start").alias("at"), F.lit(0).alias("is_offset"), "line"
    )
    looked_up = offsets.select(
        "doc_id", F.col("offset").alias("at"), F.lit(1).alias("is_offset"),
        F.lit(None).cast("long").alias("line"),
    )
    upto = W.partitionBy("doc_id").orderBy("at", "is_offset").rowsBetween(W.unboundedPreceding, 0)
    carried = starts.unionByName(looked_up).select(
        "doc_id", "at", "is_offset",
        F.last(F.when(F.col("is_offset") == 0, F.struct("line", "at")), ignorenulls=True).over(upto).alias("s"),
    )
    return carried.filter("is_offset = 1").select(
        "doc_id", F.col("at").alias("offset"), F.col("s.line").alias("line"),
        (F.col("at") - F.col("s.at")).alias("column"),
    )


def advance(line: Column, column: Column, quote: Column) -> tuple[Column, Column]:
    """Position after ``quote`` when it starts at (line, column)."""
    breaks = (F.length(quote) - F.length(F.replace(quote, F.lit("\n"), F.lit("")))).cast("long")
    tail = utf16_length(F.substring_index(quote, "\n", -1))
    return line + breaks, F.when(breaks > 0, tail).otherwise(column + tail)


BIN_UNITS = 1024


def quoted_parts(quotes: DataFrame, blocks: DataFrame, reach: int) -> DataFrame:
    """Parts (``part_start``, ``part_end``) of ``blocks(doc_id, block_no, text_start, text_end, ...)`` in which a span of at most ``reach``
    units can start that overlaps a quote.

    Blocks are narrow beside their spans: those that no quote can meet are dropped before they are made, let alone shuffled.
    """
    def parts(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / BIN_UNITS), F.floor(F.greatest(last - 1, first) / BIN_UNITS))).alias("part")

    start, end = F.col("quote_start"), F.greatest("quote_end", F.col("quote_start") + 1)
    near = quotes.select("doc_id", "block_no", parts(start - reach, end))
    every = blocks.select("*", parts(F.col("text_start"), F.col("text_end")))
    return every.join(near, ["doc_id", "block_no", "part"], "left_semi").select(
        *blocks.columns, F.greatest("text_start", F.col("part") * BIN_UNITS).alias("part_start"),
        F.least("text_end", (F.col("part") + 1) * BIN_UNITS).alias("part_end"),
    )


def overlapping(quotes: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("doc_id", "block_no")) -> DataFrame:
    """Every (quote, span) that overlap inside the same block.

    Both sides are cut into bins of the text, so a huge block spreads over many join keys and a
    quote meets only the spans of its own bins. A pair is taken in the first bin both touch.
    """

    def bins(start: str, end: str) -> Column:
        first = F.floor(F.col(start) / BIN_UNITS)
        last = F.floor(F.greatest(F.col(end) - 1, F.col(start)) / BIN_UNITS)
        return F.explode(F.sequence(first, last))

    left = quotes.withColumn("bin", bins("quote_start", "quote_end"))
    right = spans.withColumn("bin", bins("span_start", "span_end"))
    joined = left.join(right, [*keys, "bin"])
    latest_start = F.greatest("quote_start", "span_start")
    return joined.filter(
        (F.col("span_start") < F.col("quote_end"))
        & (F.col("span_end") > F.col("quote_start"))
        & (F.col("bin") == F.floor(latest_start / BIN_UNITS))
    ).drop("bin")


_QUOTE_KEY = ("doc_id", "quote_start", "quote_end")


def first_spans(quotes: DataFrame, spans: DataFrame) -> DataFrame:
    pairs = overlapping(quotes, spans)
    return pairs.groupBy(*_QUOTE_KEY).agg(F.min("span_no").alias("first_span"))


def _numbered(pairs: DataFrame, name: str, *fields: str) -> DataFrame:
    """Distinct values per quote in span order, one row each with its number."""
    ordered = F.array_sort(F.collect_list(F.struct("span_no", F.struct(*fields).alias("v"))))
    grouped = pairs.groupBy(*_QUOTE_KEY).agg(ordered.alias("found"))
    distinct = F.array_distinct(F.transform("found", lambda f: f["v"]))
    rows = grouped.select(*_QUOTE_KEY, F.posexplode(distinct).alias("i", "v"))
    return rows.select(*_QUOTE_KEY, (F.col("i") + 1).cast("long").alias(name), "v.*")


def page_regions(quotes: DataFrame, spans: DataFrame) -> DataFrame:
    """Whole regions of the spans a quote touches, first occurrence kept."""
    return _numbered(overlapping(quotes, spans), "region_no", "page", "x", "y", "width", "height")


def paragraph_ranges(quotes: DataFrame, spans: DataFrame) -> DataFrame:
    """Character ranges inside the paragraphs, clipped to the quote."""
    start, end = F.greatest("quote_start", "span_start"), F.least("quote_end", "span_end")
    base = F.col("char_start") - F.col("span_start")
    clipped = (
        overlapping(quotes, spans)
        .withColumn("range_start", base + start)
        .withColumn("range_end", base + end)
    )
    return _numbered(
        clipped, "range_no", "paragraph_id", "paragraph_index", "table_path", "range_start", "range_end"
    )


def txt_positions(found: DataFrame) -> DataFrame:
    """Line and columns of extracted text requirements; a sentence never leaves its line."""
    column = F.col("quote_start") - F.col("text_start")
    return found.select(
        "doc_id", "code", F.col("line_no").alias("start_line"), column.alias("start_column"),
        F.col("line_no").alias("end_line"),
        (F.col("quote_end") - F.col("text_start")).alias("end_column"),
    )


LOCATOR_FIELDS = (
    "code", "version", "file_name", "source_sha256", "quote", "quote_sha256", "text_start", "text_end",
    "start_line", "start_column", "end_line", "end_column",
)


def _packed(docs: DataFrame, locators: DataFrame, *fields: str) -> DataFrame:
    """One row per document: its text once, its locators (bounded by the requirement limit) packed."""
    packed = locators.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("found"))
    return packed.join(docs.select("doc_id", "text"), "doc_id", "left")


def validate_txt_locators(docs: DataFrame, locators: DataFrame) -> DataFrame:
    """``(doc_id, code, reason)``; reason is NULL for a sound locator.

    ``docs.text`` is canonical. Each text is encoded and split once for all of its locators.
    """

    def judge(encoded: Column, starts: Column, loc: Column) -> Column:
        units = utf16_length(loc["quote"])
        first, last = loc["text_start"], loc["text_end"]
        end_line, end_column = advance(loc["start_line"], loc["start_column"], loc["quote"])
        cut = F.substring(encoded, (first * 2 + 1).cast("int"), ((last - first) * 2).cast("int"))

        def differs(offset: Column, line: Column, column: Column) -> Column:
            return let(
                F.filter(starts, lambda s: s <= offset),
                lambda upto: (line != F.size(upto)) | (column != offset - F.element_at(upto, -1)),
            )

        ordered = (loc["start_line"] < loc["end_line"]) | (
            (loc["start_line"] == loc["end_line"]) & (loc["start_column"] < loc["end_column"])
        )
        return first_reason(
            (loc["version"] != 1, "VERSION"),
            (~loc["source_sha256"].rlike(fv.SHA256_HEX), "SOURCE_HASH"),
            (F.length(loc["quote"]) == 0, "QUOTE_EMPTY"),
            (loc["quote_sha256"] != F.sha2(loc["quote"], 256), "QUOTE_HASH"),
            ((first < 0) | (last <= first) | (last - first != units), "OFFSETS"),
            (F.coalesce(cut != F.encode(loc["quote"], "UTF-16BE"), F.lit(True)), "SLICE"),
            (extension_of(loc["file_name"]) != ".txt", "FILE_KIND"),
            (~ordered, "ORDER"),
            ((loc["end_line"] != end_line) | (loc["end_column"] != end_column), "QUOTE_LENGTH"),
            (
                differs(first, loc["start_line"], loc["start_column"])
                | differs(last, loc["end_line"], loc["end_column"]),
                "POSITION",
            ),
        )

    verdicts = let(
        F.encode("text", "UTF-16BE"),
        lambda encoded: let(
            _all_line_starts(F.col("text")),
            lambda starts: F.transform(
                "found",
                lambda loc: F.struct(
                    loc["code"].alias("code"), judge(encoded, starts, loc).alias("reason")
                ),
            ),
        ),
    )
    return _packed(docs, locators, *LOCATOR_FIELDS).select("doc_id", F.inline(verdicts))


def locator_reasons(locators: DataFrame) -> DataFrame:
    """``(id, kind, reason)`` of structured locators of any kind by what they say themselves; NULL for a sound one.

    ``regions`` (page, x, y, width, height), ``ranges`` (paragraph_id, paragraph_index, table_path, char_start,
    char_end) and the fixture's page number and paragraph index count for their kind only. Nothing is joined or shuffled.
    """
    rows = locators.withColumn("canonical", canonicalize(F.col("quote")))
    kind, first, last = F.col("kind"), F.col("text_start"), F.col("text_end")
    real = kind.isin("pdf", "docx", "txt")
    extension = F.coalesce(*[F.when(kind == k, suffix) for k, suffix, _ in fv.FORMATS])
    media = F.coalesce(*[F.when(kind == k, name) for k, _, name in fv.FORMATS])
    given = F.lower(F.trim(F.substring_index("media_type", ";", 1)))

    def box_fails(r: Column) -> Column:
        x, y, width, height = (r[c] for c in ("x", "y", "width", "height"))
        inside = (x >= 0) & (y >= 0) & (width > 0) & (height > 0) & (x + width <= 1) & (y + height <= 1)
        return ~F.coalesce((r["page"] >= 1) & inside, F.lit(False))

    def range_fails(r: Column) -> Column:
        placed = (r["paragraph_index"] >= 0) & (r["char_start"] >= 0) & (r["char_end"] > r["char_start"])
        known = (r["paragraph_id"].isNull() | (r["paragraph_id"] != "")) & ~F.exists(r["table_path"], lambda n: n < 0)
        return ~F.coalesce(placed & known, F.lit(False))

    reason = first_reason(
        (~real & (kind != fv.FIXTURE_METHOD), "KIND"),
        (real & (F.col("version") != 1), "VERSION"),
        (real & ~F.coalesce(F.col("source_sha256").rlike(fv.SHA256_HEX), F.lit(False)), "SOURCE_HASH"),
        (F.coalesce(F.length("quote"), F.lit(0)) == 0, "QUOTE_EMPTY"),
        (real & (F.col("quote") != F.col("canonical")), "NOT_CANONICAL"),
        (real & (F.col("quote_sha256") != F.sha2("quote", 256)), "QUOTE_HASH"),
        (real & ((first < 0) | (last <= first) | (last - first != utf16_length(F.col("quote")))), "OFFSETS"),
        (real & (extension_of(F.col("file_name")) != extension), "FILE_KIND"),
        (real & F.coalesce(given != media, F.lit(False)), "MEDIA_TYPE"),
        ((kind == "pdf") & ((F.size("regions") == 0) | F.exists("regions", box_fails)), "REGIONS"),
        ((kind == "docx") & ((F.size("ranges") == 0) | F.exists("ranges", range_fails)), "RANGES"),
        (
            (kind == fv.FIXTURE_METHOD) & (F.col("page_number").isNotNull() | F.col("fixture_index").isNotNull()), "FIXTURE",
        ),
    )
    return rows.select("id", "kind", reason.alias("reason"))


def relocate_quotes(docs: DataFrame, locators: DataFrame) -> DataFrame:
    """exact: still at its offsets; relocated: found elsewhere in the text; lost."""

    def triage(encoded: Column, loc: Column) -> Column:
        size = ((loc["text_end"] - loc["text_start"]) * 2).cast("int")
        cut = F.substring(encoded, (loc["text_start"] * 2 + 1).cast("int"), size)
        return (
            F.when(cut == F.encode(loc["quote"], "UTF-16BE"), "exact")
            .when(F.contains(F.col("text"), loc["quote"]), "relocated")
            .otherwise("lost")
        )

    verdicts = let(
        F.encode(F.coalesce("text", F.lit("")), "UTF-16BE"),
        lambda encoded: F.transform(
            "found",
            lambda loc: F.struct(loc["code"].alias("code"), triage(encoded, loc).alias("outcome")),
        ),
    )
    return _packed(docs, locators, "code", "quote", "text_start", "text_end").select(
        "doc_id", F.inline(verdicts)
    )


def locator_json() -> Column:
    """The stored JSON of an extracted text requirement."""
    return F.to_json(
        F.struct(
            F.lit("txt").alias("kind"), F.col("version"), F.col("doc_id").alias("sourceFileId"),
            F.col("file_name").alias("sourceFileName"), F.lit(1).alias("sourceRevision"),
            F.col("source_sha256").alias("sourceSha256"), F.col("quote"),
            F.col("quote_sha256").alias("quoteSha256"), F.col("text_start").alias("textStart"),
            F.col("text_end").alias("textEnd"), F.col("section_path").alias("sectionPath"),
            F.lit(fv.PARSER_VERSION).alias("parserVersion"),
            F.struct(F.col("start_line").alias("line"), F.col("start_column").alias("column")).alias("start"),
            F.struct(F.col("end_line").alias("line"), F.col("end_column").alias("column")).alias("end"),
        )
    )


def key_differences(locators: DataFrame, json: str = "locator") -> DataFrame:
    """Missing and unknown keys of each locator against the key list of its kind."""
    kind = F.get_json_object(json, "$.kind")
    have = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    wanted = F.coalesce(
        *[F.when(kind == k, F.array(*[F.lit(n) for n in names])) for k, names in fv.LOCATOR_KEYS.items()]
    )
    return locators.select(
        "id", kind.alias("kind"),
        F.array_join(F.array_sort(F.array_except(wanted, have)), "|").alias("missing"),
        F.array_join(F.array_sort(F.array_except(have, wanted)), "|").alias("unknown"),
    )


def evidence_reason() -> Column:
    """Extraction method against locator kind, task type and confidence."""
    method, kind, task = F.col("extraction_method"), F.col("kind"), F.col("task_type")
    confidence = F.col("confidence")
    fixture, rules = method == fv.FIXTURE_METHOD, method == fv.PARSER_VERSION
    return first_reason(
        (
            fixture
            & ((kind != fv.FIXTURE_METHOD) | confidence.isNotNull() | (task != fv.FIXTURE_TASK_TYPE)),
            "FIXTURE_INCONSISTENT",
        ),
        (~fixture & ~rules, "METHOD"),
        (rules & ((kind == fv.FIXTURE_METHOD) | (task != fv.RULE_TASK_TYPE)), "RULES_INCONSISTENT"),
        (rules & (confidence.isNull() | (confidence < 0) | (confidence > 1)), "CONFIDENCE_RANGE"),
        (rules & (F.round(confidence, 4) != confidence), "CONFIDENCE_DECIMALS"),
    )
