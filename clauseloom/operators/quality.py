"""Predicates and data-quality checks: each returns rows with a reason code, or the offenders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from clauseloom.functions import fixed_values as fv
from clauseloom.functions.text import let, trim_ws, utf16_length


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The code of the first failed check, NULL when none fails. A NULL test does not fail."""
    chain = F.when(checks[0][0], checks[0][1])
    for test, code in checks[1:]:
        chain = chain.when(test, code)
    return chain


def project_fields(forms: DataFrame) -> DataFrame:
    def optional(name: str) -> Column:
        return F.when(F.col(name) != "", trim_ws(F.col(name)))

    def too_long(name: str, limit: int) -> Column:
        return utf16_length(trim_ws(F.col(name))) > limit

    name = trim_ws(F.col("name"))
    units = utf16_length(name)
    reason = first_reason(
        (F.col("name").isNull() | (units == 0) | (units > 160), "INVALID_PROJECT_NAME"),
        (too_long("code", 80) | too_long("customer_name", 160) | too_long("owner_name", 160), "INVALID_BODY"),
    )
    return forms.select(
        "form_id",
        name.alias("name"),
        *[optional(c).alias(c) for c in ("code", "customer_name", "owner_name")],
        reason.alias("reject_reason"),
    )


def rfc3339(value: Column) -> Column:
    """Normalised UTC text with milliseconds, NULL when not a valid RFC 3339 date-time."""

    def part(n: int) -> Column:
        return F.regexp_extract(value, fv.RFC3339, n)

    def number(n: int) -> Column:
        return part(n).try_cast("int")

    sound = (
        value.rlike(fv.RFC3339)
        & (number(4) <= 23)
        & (number(5) <= 59)
        & (number(6) <= 59)
        & (F.coalesce(number(9), F.lit(0)) <= 23)
        & (F.coalesce(number(10), F.lit(0)) <= 59)
    )
    local = F.try_make_timestamp_ntz(number(1), number(2), number(3), number(4), number(5), number(6))
    minutes = F.coalesce(number(9), F.lit(0)) * 60 + F.coalesce(number(10), F.lit(0))
    shift = F.when(part(8).startswith("-"), minutes).otherwise(-minutes)
    utc = F.timestamp_add("MINUTE", shift, local)
    millis = F.rpad(F.substring(part(7), 2, 3), 3, "0")
    text = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss."), millis, F.lit("Z"))
    return F.when(sound, text)


_LOCAL_FORM = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})(?::(\d{2}))?$"


def local_date_time(value: Column) -> Column:
    """A form's date-time without offset: NTZ timestamp, NULL unless every field round-trips."""

    def number(n: int) -> Column:
        return F.nullif(F.regexp_extract(value, _LOCAL_FORM, n), F.lit("")).try_cast("int")

    second = F.coalesce(number(6), F.lit(0))
    made = F.try_make_timestamp_ntz(number(1), number(2), number(3), number(4), number(5), second)
    # Two-digit years are read as 19xx by the form and so never round-trip; second 60 rolls over.
    return F.when(value.rlike(_LOCAL_FORM) & (number(1) >= 100) & (second <= 59), made)


def upload_name(raw: Column) -> Column:
    """Last path component, either slash kind, edges trimmed."""
    slashed = F.regexp_replace(F.regexp_replace(raw, r"\\", "/"), "/+$", "")
    return trim_ws(F.substring_index(slashed, "/", -1))


def upload_reason(name: Column, size: Column) -> Column:
    # A leading dot alone starts a hidden name, not an extension.
    extension = F.lower(F.regexp_extract(name, r"(?s)^.+?(\.[^.]*)\z", 1))
    return first_reason(
        ((utf16_length(name) == 0) | (utf16_length(name) > 255), "INVALID_FILE_NAME"),
        (~extension.isin(*[e for _, e, _ in fv.FORMATS]), "UNSUPPORTED_FILE_TYPE"),
        (size > fv.MAX_UPLOAD_BYTES, "FILE_TOO_LARGE"),
        (size == 0, "EMPTY_FILE"),
    )


def extension_of(file_name: Column) -> Column:
    """Text from the last dot on, lower case; empty without a dot."""
    return F.when(
        file_name.contains("."), F.lower(F.concat(F.lit("."), F.substring_index(file_name, ".", -1)))
    ).otherwise("")


def media_essence(media_type: Column) -> Column:
    return F.lower(trim_ws(F.substring_index(media_type, ";", 1)))


def route_formats(files: DataFrame, head: str = "head") -> DataFrame:
    """Adds ``format`` or ``reject_reason``; the three known pairs are literals in the plan."""
    extension, essence = extension_of(F.col("file_name")), media_essence(F.col("media_type"))
    expected = reduce(
        lambda acc, f: acc.when(extension == f[1], f[2]), fv.FORMATS[1:],
        F.when(extension == fv.FORMATS[0][1], fv.FORMATS[0][2]),
    )
    known_type = essence.isin(*[m for _, _, m in fv.FORMATS])
    reason = first_reason(
        (expected.isNotNull() & (expected != essence), "FORMAT_MISMATCH"),
        (expected.isNull() & known_type, "FORMAT_MISMATCH"),
        (expected.isNull(), "UNSUPPORTED_DOCUMENT_FORMAT"),
        ((extension == ".docx") & F.col(head).startswith("%PDF-"), "FORMAT_MISMATCH"),
    )
    return files.withColumn("reject_reason", reason).withColumn(
        "format", F.when(reason.isNull(), F.substring(extension, 2, 10))
    )


def integrity_reason(declared: Column, actual: Column, stored: Column, digest: Column) -> Column:
    return first_reason(
        (declared != actual, "SIZE_MISMATCH"),
        (actual > fv.LIMITS["bytes"], "DOCUMENT_RESOURCE_LIMIT_EXCEEDED"),
        (~stored.rlike(fv.SHA256_HEX), "DIGEST_NOT_LOWERCASE_HEX"),
        (stored != digest, "DIGEST_MISMATCH"),
    )


def lineage_orphans(tasks: DataFrame, files: DataFrame, requirements: DataFrame) -> DataFrame:
    """Rows whose composite foreign key has no parent."""
    file_key = ["tenant_id", "project_id", "file_id"]
    parents = files.select("tenant_id", "project_id", F.col("id").alias("file_id"))
    lost_tasks = tasks.join(parents, file_key, "left_anti").select(
        F.lit("task").alias("entity"), "tenant_id", "id"
    )
    owners = tasks.select(*file_key, F.col("id").alias("task_id"))
    lost_requirements = requirements.join(owners, [*file_key, "task_id"], "left_anti").select(
        F.lit("requirement").alias("entity"), "tenant_id", "id"
    )
    return lost_tasks.unionByName(lost_requirements)


def duplicate_keys(df: DataFrame, check: str, *keys: str) -> DataFrame:
    """Keys that occur more than once; rows with a NULL key are exempt, as in a unique index."""
    present = df.dropna(subset=list(keys))
    counted = present.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")
    return counted.select(F.lit(check).alias("check_name"), F.concat_ws("/", *keys).alias("key"), "copies")


def _filled(name: str) -> Column:
    return F.col(name).isNotNull() & (F.trim(name) != "")


def broken_rules(df: DataFrame, entity: str, rules: dict[str, Column]) -> DataFrame:
    """One row per violated rule; a rule that is NULL passes, as a CHECK constraint does."""
    tests = F.array(*[F.when(~ok, name) for name, ok in rules.items()])
    return df.select(
        F.lit(entity).alias("entity"), "id",
        F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("rule"),
    )


def state_shape_violations(tasks: DataFrame, outbox: DataFrame, files: DataFrame) -> DataFrame:
    leased = _filled("lease_token") & _filled("lease_owner") & F.col("lease_expires_at").isNotNull()
    bare = F.col("lease_token").isNull() & F.col("lease_owner").isNull() & F.col("lease_expires_at").isNull()
    running = F.col("status") == "running"
    task_rules = {
        "lease_shape": (running & leased) | (~running & bare),
        "dead_letter_shape": F.col("dead_lettered_at").isNull() | (F.col("status") == "failed"),
    }
    free = F.col("lease_owner").isNull() & F.col("lease_expires_at").isNull()
    outbox_rules = {
        "outbox_lease_shape": free | (_filled("lease_owner") & F.col("lease_expires_at").isNotNull()),
        "published_has_no_lease": F.col("published_at").isNull() | free,
    }
    inline = (
        F.col("object_key").isNull() & F.col("object_etag").isNull()
        & F.col("object_stored_at").isNull() & F.col("content").isNotNull()
    )
    stored = _filled("object_key") & F.col("object_stored_at").isNotNull()
    return (
        broken_rules(tasks, "task", task_rules)
        .unionByName(broken_rules(outbox, "outbox", outbox_rules))
        .unionByName(broken_rules(files, "file", {"storage_source": inline | stored}))
    )


def evidence_shape_violations(requirements: DataFrame) -> DataFrame:
    """Confidence, kind and version against the extraction method. A missing JSON value fails."""
    kind = F.get_json_object("locator_json", "$.kind")
    # A typed look: the text "1" is not the number 1.
    version = F.try_variant_get(F.try_parse_json("locator_json"), "$.version", "variant")
    is_one = (F.schema_of_variant(version) == "BIGINT") & (
        F.get_json_object("locator_json", "$.version") == "1"
    )
    fixture, rules = (F.col("extraction_method") == m for m in (fv.FIXTURE_METHOD, fv.PARSER_VERSION))
    confidence = F.col("confidence")
    confidence_ok = (fixture & confidence.isNull()) | (
        rules & confidence.isNotNull() & confidence.between(0, 1)
    )
    locator_ok = (fixture & F.coalesce(kind == fv.FIXTURE_METHOD, F.lit(False))) | (
        rules
        & F.coalesce(kind.isin("pdf", "docx", "txt"), F.lit(False))
        & F.coalesce(is_one, F.lit(False))
    )
    return broken_rules(
        requirements, "requirement", {"confidence": confidence_ok, "evidence_kind": locator_ok}
    )


def over_limit_documents(
    sizes: DataFrame, limits: dict[str, int] = fv.LIMITS, columns: tuple[str, ...] = tuple(fv.LIMITS)
) -> DataFrame:
    """``sizes(doc_id, <columns>)`` → the documents to fail, with every limit they exceed.

    The whole document fails; nothing is cut to fit.
    """
    hits = F.filter(
        F.array(*[F.when(F.col(c) > limits[c], c) for c in columns]), lambda c: c.isNotNull()
    )
    return sizes.withColumn("exceeded", hits).filter(F.size("exceeded") > 0)


def document_sizes(docs: DataFrame, blocks: DataFrame, requirements: DataFrame) -> DataFrame:
    """Sizes of text documents against every limit: a block has one source span, and there are no pages."""
    units = docs.select(
        "doc_id", utf16_length(F.col("text")).alias("units"), F.octet_length("text").cast("long").alias("bytes")
    )
    counted = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    found = requirements.groupBy("doc_id").agg(F.count("*").alias("requirements"))
    zero = F.lit(0).cast("long")
    return units.join(counted, "doc_id", "left").join(found, "doc_id", "left").select(
        "doc_id", "bytes", "units", F.coalesce("blocks", zero).alias("blocks"),
        F.coalesce("requirements", zero).alias("requirements"), F.coalesce("blocks", zero).alias("spans"), zero.alias("pages"),
    )


def page_document_sizes(runs: DataFrame) -> DataFrame:
    """Sizes of page documents known before they are put together: spans, pages and what their runs hold."""
    zero = F.lit(0).cast("long")
    return runs.groupBy("doc_id").agg(
        F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sum(utf16_length(F.col("text"))).alias("units"),
        F.count("*").alias("spans"), F.count_distinct("page").alias("pages"),
    ).select("doc_id", "bytes", "units", zero.alias("blocks"), zero.alias("requirements"), "spans", "pages")


def block_span_violations(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """``blocks(doc_id, block_no, text_start, text_end)`` and ``spans(doc_id, block_no, span_no, span_start, span_end)`` →
    spans that are empty, without a block, outside their block, or begin before the one ahead has ended."""
    order = W.partitionBy("doc_id", "block_no").orderBy("span_no")
    ends = spans.withColumn("previous_end", F.coalesce(F.lag("span_end").over(order), F.lit(-1).cast("long")))
    joined = ends.join(blocks.select("doc_id", "block_no", "text_start", "text_end"), ["doc_id", "block_no"], "left")
    reason = first_reason(
        (F.col("text_start").isNull(), "NO_BLOCK"),
        (
            (F.col("span_end") <= F.col("span_start")) | (F.col("span_start") < F.col("text_start"))
            | (F.col("span_end") > F.col("text_end")), "SPAN_RANGE",
        ),
        (F.col("span_start") < F.col("previous_end"), "SPAN_ORDER"),
    )
    return joined.select("doc_id", "block_no", "span_no", reason.alias("reason")).filter("reason IS NOT NULL")


def _blocks_with_text(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per document: text plus its ordered blocks. A document's blocks are bounded by the
    block limit, and each text is joined once instead of once per block."""
    packed = blocks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("block_no", "text_start", "text_end", "line"))).alias("blocks")
    )
    return docs.select("doc_id", "text").join(packed, "doc_id", "left")


def _previous(blocks: Column, i: Column, name: str, at_start: int) -> Column:
    return F.coalesce(F.get(blocks, i - 1)[name], F.lit(at_start).cast("long"))


def block_violations(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks that are empty, out of range, overlap their predecessor, or differ from their slice."""

    def judge(encoded: Column, units: Column, found: Column) -> Column:
        def reason(b: Column, i: Column) -> Column:
            size = ((b["text_end"] - b["text_start"]) * 2).cast("int")
            cut = F.substring(encoded, (b["text_start"] * 2 + 1).cast("int"), size)
            return F.struct(
                b["block_no"].alias("block_no"),
                first_reason(
                    (
                        (b["text_start"] < 0) | (b["text_end"] <= b["text_start"]) | (b["text_end"] > units),
                        "RANGE",
                    ),
                    (b["text_start"] < _previous(found, i, "text_end", -1), "OVERLAP"),
                    (cut != F.encode(b["line"], "UTF-16BE"), "SLICE"),
                ).alias("reason"),
            )

        return F.filter(F.transform(found, reason), lambda r: r["reason"].isNotNull())

    verdicts = let(
        F.encode("text", "UTF-16BE"),
        lambda encoded: judge(encoded, F.shiftright(F.octet_length(encoded), 1), F.col("blocks")),
    )
    return _blocks_with_text(docs, blocks).select("doc_id", F.inline(verdicts))


def uncovered_text(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per text document: gaps between (and after) blocks that hold anything but newlines."""

    def gaps(encoded: Column, found: Column) -> Column:
        total = F.shiftright(F.octet_length(encoded), 1).cast("long")

        def hidden(start: Column, end: Column) -> Column:
            cut = F.substring(encoded, (start * 2 + 1).cast("int"), ((end - start) * 2).cast("int"))
            return (end > start) & F.regexp_replace(F.hex(cut), "000A", "").rlike(".")

        inner = F.transform(
            found, lambda b, i: hidden(_previous(found, i, "text_end", 0), b["text_start"])
        )
        last = F.coalesce(F.get(found, F.size(found) - 1)["text_end"], F.lit(0).cast("long"))
        return F.concat(inner, F.array(hidden(last, total)))

    found = F.coalesce("blocks", F.array().cast("array<struct<block_no:bigint,text_start:bigint,text_end:bigint,line:string>>"))
    verdicts = let(F.encode("text", "UTF-16BE"), lambda encoded: let(found, lambda f: gaps(encoded, f)))
    counted = F.size(F.filter(verdicts, lambda hidden: hidden)).cast("long")
    return _blocks_with_text(docs, blocks).select("doc_id", counted.alias("hidden_gaps"))


def span_reason(fmt: str = "format") -> Column:
    """One exploded source span against the document format and its own ranges."""
    kind = F.col("kind")
    unit = [F.col(c) for c in ("x", "y", "width", "height")]
    x, y, width, height = unit
    pdf_bad = (
        (F.col("page") < 1) | (x < 0) | (y < 0) | (width <= 0) | (height <= 0)
        | (x + width > 1) | (y + height > 1)
    )
    docx_bad = (F.col("paragraph_index") < 0) | F.exists("table_path", lambda n: n < 0) | (
        F.col("char_end") <= F.col("char_start")
    ) | (
        F.col("char_end") - F.col("char_start") != F.col("text_end") - F.col("text_start")
    )
    txt_bad = (F.col("start_line") != F.col("end_line")) | (
        F.col("end_col") - F.col("start_col") != F.col("text_end") - F.col("text_start")
    )
    return first_reason(
        (kind != F.col(fmt), "KIND"),
        ((kind == "pdf") & pdf_bad, "PDF_BOX"),
        ((kind == "docx") & docx_bad, "DOCX_RANGE"),
        ((kind == "txt") & txt_bad, "TXT_POSITION"),
    )


ERROR_SCHEMA = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("message", T.StringType())]
)


def failure_class(code: Column) -> Column:
    return (
        F.when(code.isin(*fv.FAILURE_CODES), "permanent")
        .when(code.isin(*fv.TRANSIENT_CODES), "transient")
        .when(code.isNotNull(), "unknown")
    )
