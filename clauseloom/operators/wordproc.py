"""Word-processor structure: style inheritance, headings, numbering, markers, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clauseloom.functions.text import WS_CHARS, let, nfc, pin, running_starts, utf16_length

BODY = 9
DEEPEST_LEVEL = 9
_HEADING_NAME = r"(?i)^Heading[\s\x{A0}\x{3000}]*([1-9])$"


def _name_level(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(name, F.lit("")), _HEADING_NAME, 1), F.lit("")).cast("long")


def with_inherited_styles(documents: DataFrame) -> DataFrame:
    """Each paragraph with what its style chain defines (outline level, name fallback, numbering) and with the levels
    of its list. Rejected documents have no paragraphs; ``rejected`` returns them.

    The chain is walked inside the row over the document's own style table. As many steps as there
    are styles always suffice, so a cycle ends by itself.
    """
    lookup = F.map_from_entries(
        F.transform("styles", lambda s: F.struct(s["style_id"].alias("key"), s.alias("value")))
    )

    def resolve(styles: Column, style_id: Column) -> Column:
        start = F.struct(
            style_id.alias("current"), F.lit(None).cast("long").alias("outline"),
            _name_level(style_id).alias("fallback"), F.lit(None).cast("string").alias("num_id"),
            F.lit(None).cast("long").alias("num_level"),
        )

        def step(acc: Column, _n: Column) -> Column:
            def move(style: Column) -> Column:
                # The name only counts while no outline level has been met on the way.
                named = F.coalesce(acc["fallback"], _name_level(style["name"]), _name_level(acc["current"]))
                found = style["outline_level"].isNotNull()
                return F.struct(
                    style["based_on"].alias("current"),
                    F.coalesce(acc["outline"], style["outline_level"]).alias("outline"),
                    F.when(acc["outline"].isNotNull() | found, acc["fallback"]).otherwise(named).alias("fallback"),
                    F.coalesce(acc["num_id"], style["num_id"]).alias("num_id"),
                    F.coalesce(acc["num_level"], style["num_level"]).alias("num_level"),
                )

            known = let(F.try_element_at(styles, acc["current"]), move)
            return F.when(
                acc["current"].isNotNull() & F.try_element_at(styles, acc["current"]).isNotNull(), known
            ).otherwise(
                F.struct(
                    F.lit(None).cast("string").alias("current"), acc["outline"].alias("outline"),
                    acc["fallback"].alias("fallback"), acc["num_id"].alias("num_id"),
                    acc["num_level"].alias("num_level"),
                )
            )

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("styles"), F.lit(1))), start, step)

    used = F.array_distinct(F.filter(F.transform("paragraphs", lambda p: p["style_id"]), lambda s: s.isNotNull()))
    chains = let(
        lookup,
        lambda styles: F.map_from_entries(
            F.transform(used, lambda s: F.struct(s.alias("key"), resolve(styles, s).alias("value")))
        ),
    )

    def listed(p: Column, chain: Column, lists: Column) -> Column:
        number = F.coalesce(p["num_id"], chain["num_id"])
        return F.struct(p.alias("p"), chain.alias("chain"), F.try_element_at(lists, number).alias("levels"))

    resolved = let(chains, lambda c: let(
        list_levels(F.col("nums"), F.col("levels"), F.col("overrides")),
        lambda lists: F.transform("paragraphs", lambda p: listed(p, F.try_element_at(c, p["style_id"]), lists)),
    ))
    rows = documents.filter("reject_reason IS NULL").select("doc_id", F.inline(resolved))
    return rows.select("doc_id", "p.*", "chain", "levels")


def with_heading_level(paragraphs: DataFrame) -> DataFrame:
    """Direct outline level, else the chain's, else the level in a ``Heading N`` name."""
    own, chain = F.col("outline_level"), F.col("chain")
    effective = F.coalesce(own, chain["outline"])
    level = F.when(effective == BODY, None).when(effective.isNotNull(), effective + 1).otherwise(chain["fallback"])
    return paragraphs.withColumn("heading_level", level)


def with_numbering(paragraphs: DataFrame) -> DataFrame:
    """``list_id`` and ``list_level``: direct values first, then inherited, level 0 by default."""
    number = F.coalesce("num_id", F.col("chain.num_id"))
    level = F.coalesce("num_level", F.col("chain.num_level"), F.lit(0).cast("long"))
    return paragraphs.withColumn("list_id", number).withColumn(
        "list_level", F.when(number.isNotNull(), level)
    )


_LEVEL = "struct<start:bigint,format:string,text:string>"


def list_levels(nums: Column, levels: Column, overrides: Column) -> Column:
    """Effective levels per list, as a map of maps: abstract levels, replaced or restarted by the list's overrides.

    Everything lies in the document's row, so the lists are resolved there.
    """

    def of_list(num: Column) -> Column:
        base = F.filter(levels, lambda v: v["abstract_id"] == num["abstract_id"])
        own = F.filter(overrides, lambda o: o["num_id"] == num["num_id"])

        def one(depth: Column) -> Column:
            below = F.get(F.filter(base, lambda v: v["level"] == depth), F.lit(0))
            above = F.get(F.filter(own, lambda o: o["level"] == depth), F.lit(0))
            replaced = above["format"].isNotNull() & above["text"].isNotNull()
            start, form, text = (F.when(replaced, above[c]).otherwise(below[c]) for c in ("start", "format", "text"))
            made = F.struct(
                F.coalesce(above["start_override"], start).alias("start"), form.alias("format"), text.alias("text")
            )
            return F.struct(depth.alias("key"), made.cast(_LEVEL).alias("value"))

        depths = F.array_distinct(F.concat(F.transform(base, lambda v: v["level"]), F.transform(own, lambda o: o["level"])))
        found = F.filter(F.transform(depths, one), lambda e: e["value"]["format"].isNotNull())
        return F.struct(num["num_id"].alias("key"), F.map_from_entries(found).alias("value"))

    usable = F.filter(nums, lambda n: F.exists(levels, lambda v: v["abstract_id"] == n["abstract_id"]))
    return F.map_from_entries(F.transform(usable, of_list))


def with_counters(paragraphs: DataFrame) -> DataFrame:
    """Counter values 0..8 of a paragraph's list at that paragraph (NULL = not set).

    A level counts on from its start and forgets its value when a shallower level of the same list
    appears. Both are running windows per list: each level's run is numbered, then the latest value
    per level is carried forward.
    """
    joined = paragraphs.withColumn("definition", F.try_element_at("levels", F.col("list_level")))
    listed = F.col("definition").isNotNull()
    rows = joined.withColumn("at", F.when(listed, F.col("list_level")))
    upto = W.partitionBy("doc_id", "list_id").orderBy("paragraph_index").rowsBetween(W.unboundedPreceding, 0)
    depths = range(DEEPEST_LEVEL)
    shallower = F.coalesce(
        *[F.when(F.col("at") == n, F.count_if(F.col("at") < n).over(upto)) for n in depths]
    )
    run = W.partitionBy("doc_id", "list_id", "at", "run").orderBy("paragraph_index")
    counted = rows.withColumn("run", shallower).withColumn(
        "own", F.when(F.col("at").isNotNull(), F.col("definition.start") + F.row_number().over(run) - 1)
    )
    cleared = F.lit(-1).cast("long")
    values = [
        F.last(F.when(F.col("at") == n, F.col("own")).when(F.col("at") < n, cleared), ignorenulls=True).over(upto)
        for n in depths
    ]
    return counted.withColumn(
        "counters", F.when(listed, F.transform(F.array(*values), lambda v: F.nullif(v, cleared)))
    ).drop("run", "own", "at")


_ROMAN = (
    ("", "M", "MM", "MMM"),
    ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
    ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
)


def roman(value: Column) -> Column:
    """Upper-case Roman for 1..3999, NULL outside."""
    digits = [
        F.get(F.array(*[F.lit(s) for s in symbols]), (F.floor(value / 10 ** (3 - i)) % 10).cast("int"))
        for i, symbols in enumerate(_ROMAN)
    ]
    return F.when(value.between(1, 3999), F.concat(*digits))


def letters(value: Column) -> Column:
    """A..Z, AA..: bijective base 26; empty below 1."""
    start = F.struct(value.cast("long").alias("rest"), F.lit("").alias("text"))

    def step(acc: Column, _n: Column) -> Column:
        rest = acc["rest"] - 1
        digit = F.char((F.lit(65) + rest % 26).cast("long"))
        return F.when(
            acc["rest"] > 0,
            F.struct(F.floor(rest / 26).cast("long").alias("rest"), F.concat(digit, acc["text"]).alias("text")),
        ).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["text"])


def format_counter(value: Column, fmt: Column) -> Column:
    """Text of a counter in its number format; NULL for a format without rule."""
    cased = F.when(fmt.endswith("Letter"), letters(value)).when(fmt.endswith("Roman"), roman(value))
    return (
        F.when(fmt == "decimal", value.cast("string"))
        .when(fmt.isin("lowerLetter", "lowerRoman"), F.lower(cased))
        .when(fmt.isin("upperLetter", "upperRoman"), cased)
        .when(fmt == "bullet", "")
    )


def with_markers(paragraphs: DataFrame) -> DataFrame:
    """``marker``: the level text with %1..%9 filled in, NULL when any part cannot be resolved."""
    values = F.transform(
        "counters",
        lambda v, n: format_counter(v, F.try_element_at("levels", n.cast("long"))["format"]),
    )
    rows = pin(paragraphs, formatted=values)

    def fill(acc: Column, n: Column) -> Column:
        mark = F.concat(F.lit("%"), (n + 1).cast("string"))
        value = F.get("formatted", n)
        return F.struct(
            F.replace(acc["text"], mark, F.coalesce(value, F.lit(""))).alias("text"),
            (acc["sound"] & (~F.contains(acc["text"], mark) | value.isNotNull())).alias("sound"),
        )

    start = F.struct(F.col("definition.text").alias("text"), F.lit(True).alias("sound"))
    filled = F.aggregate(F.sequence(F.lit(0), F.lit(DEEPEST_LEVEL - 1)), start, fill)
    usable = filled["sound"] & (F.col("definition.format") != "none") & (F.length(filled["text"]) > 0)
    raw = pin(rows, raw_marker=F.when(usable, filled["text"]))
    return pin(raw, marker=nfc(F.col("raw_marker"))).drop("formatted", "raw_marker")


def _paths(headings: Column) -> Column:
    """Path at each heading of the main text: the first level-1 titles kept, then its own text."""
    start = F.struct(
        F.array().cast("array<string>").alias("path"), F.array().cast("array<array<string>>").alias("paths")
    )

    def step(acc: Column, h: Column) -> Column:
        kept = F.slice(acc["path"], F.lit(1), (h["level"] - 1).cast("int"))
        return let(
            F.concat(kept, F.array(h["text"])),
            lambda now: F.struct(
                F.when(h["in_table"], acc["path"]).otherwise(now).alias("path"),
                F.concat(acc["paths"], F.array(now)).alias("paths"),
            ),
        )

    return F.aggregate(headings, start, step, lambda acc: acc["paths"])


def document_blocks(paragraphs: DataFrame) -> DataFrame:
    """Ordered blocks of each document with offsets, kinds, section paths and source ranges.

    ``paragraphs`` carry ``heading_level`` and ``marker``. Empty paragraphs give no block.
    """
    prefix = F.when(F.col("marker").isNull(), "").when(
        F.length(F.rtrim("marker", F.lit(WS_CHARS))) < F.length("marker"), F.col("marker")
    ).otherwise(F.concat("marker", F.lit(" ")))
    body = pin(paragraphs.filter(F.length("text") > 0).withColumnRenamed("text", "body"), prefix=prefix)
    joined = pin(body, joined=F.concat("prefix", "body"))
    visible = joined.select(
        "doc_id", "paragraph_index", "paragraph_id", "table_path", "heading_level",
        (F.size("table_path") > 0).alias("in_table"), "body", "prefix", nfc(F.col("joined")).alias("text"),
    )
    packed = visible.groupBy("doc_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("paragraph_index", "paragraph_id", "table_path", "heading_level", "in_table", "body", "prefix", "text")
            )
        ).alias("ps")
    )

    ps = F.col("ps")
    headings = F.transform(
        F.filter(ps, lambda p: p["heading_level"].isNotNull()),
        lambda p: F.struct(p["heading_level"].alias("level"), p["text"].alias("text"), p["in_table"].alias("in_table")),
    )
    is_heading = F.transform(ps, lambda p: F.when(p["heading_level"].isNotNull(), 1).otherwise(0).cast("long"))
    # A table heading shows its own path, but the text after it continues the main path.
    leads = F.transform(
        ps, lambda p: F.when(p["heading_level"].isNotNull() & ~p["in_table"], 1).otherwise(0).cast("long")
    )
    placed = pin(
        packed, at=running_starts(F.transform(ps, lambda p: utf16_length(p["text"]) + 1)), seen=running_starts(is_heading),
        led=running_starts(leads), headings=headings,
    )
    pathed = pin(placed, paths=_paths(F.col("headings")))
    main = F.transform(
        F.filter(F.arrays_zip(F.col("headings").alias("h"), F.col("paths").alias("path")), lambda z: ~z["h"]["in_table"]),
        lambda z: z["path"],
    )

    def block(p: Column, i: Column) -> Column:
        own = F.get("paths", F.get("seen", i).cast("int"))
        running = F.coalesce(F.get("main", (F.get("led", i) - 1).cast("int")), F.array().cast("array<string>"))
        heading, start = p["heading_level"].isNotNull(), F.get("at", i)
        return F.struct(
            (i + 1).cast("long").alias("block_no"),
            F.when(heading, "heading").when(p["in_table"], "table-cell").otherwise("paragraph").alias("kind"),
            p["text"].alias("text"), start.alias("text_start"), (start + utf16_length(p["text"])).alias("text_end"),
            F.when(heading, own).otherwise(running).alias("section_path"),
            (start + utf16_length(p["prefix"])).alias("span_start"), p["paragraph_index"].alias("paragraph_index"),
            p["paragraph_id"].alias("paragraph_id"), p["table_path"].alias("table_path"),
            utf16_length(p["body"]).alias("char_end"),
        )

    return pin(pathed, main=main).select("doc_id", F.inline(F.transform(ps, block)))


def extract_blocks(documents: DataFrame) -> DataFrame:
    """``read_docx`` rows → blocks of the documents that could be read."""
    styled = with_numbering(with_heading_level(with_inherited_styles(documents)))
    return document_blocks(with_markers(with_counters(styled)))


def rejected(documents: DataFrame) -> DataFrame:
    """``(doc_id, reject_reason)`` of the documents that give no blocks: malformed, or above an archive limit."""
    return documents.filter("reject_reason IS NOT NULL").select("doc_id", "reject_reason")
