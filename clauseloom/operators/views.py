"""Relational reads, view models and row updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv
from clauseloom.functions.formats import file_category, file_size, percent
from clauseloom.functions.text import trim_ws, utf16_length


def newest_first(df: DataFrame) -> DataFrame:
    """Creation time descending; the id breaks ties."""
    return df.orderBy(F.desc("created_at"), "id")


def scoped(df: DataFrame, tenant_id: str, project_id: str | None = None) -> DataFrame:
    """Rows of one tenant, or of one of its projects: ids are unique within a tenant only."""
    own = df.filter(F.col("tenant_id") == tenant_id)
    return own if project_id is None else own.filter(F.col("project_id") == project_id)


def latest_task(tasks: DataFrame, only: Column | None = None) -> DataFrame:
    """The newest task of each file: a map-side combined ``max_by``, no per-file sort."""
    rows = tasks if only is None else tasks.filter(only)
    rank = F.struct("created_at", "id")
    return rows.groupBy("tenant_id", "file_id").agg(
        F.max_by(F.struct("id", "status", "progress", "error", "created_at"), rank).alias("task")
    )


def requirement_list(
    requirements: DataFrame,
    files: DataFrame,
    tasks: DataFrame,
    tenant_id: str,
    project_id: str,
    confirmation_status: str | None = None,
    priority: str | None = None,
) -> DataFrame:
    """Requirements of one project with the metadata of their file and task, joined on the composite keys.

    The scope and the optional filters are applied first, so they reach the requirement scan.
    """
    rows = scoped(requirements, tenant_id, project_id)
    if confirmation_status is not None:
        rows = rows.filter(F.col("confirmation_status") == confirmation_status)
    if priority is not None:
        rows = rows.filter(F.col("priority") == priority)
    file_side = files.select(
        "tenant_id", "project_id", F.col("id").alias("file_id"),
        F.col("file_name").alias("source_file_name"), F.col("sha256").alias("source_file_sha256"),
        F.col("media_type").alias("source_file_media_type"),
    )
    task_side = tasks.select(
        "tenant_id", "project_id", "file_id", F.col("id").alias("task_id"),
        F.col("type").alias("source_task_type"),
    )
    key = ["tenant_id", "project_id", "file_id"]
    return rows.join(file_side, key).join(task_side, [*key, "task_id"])


def confirm(requirements: DataFrame, decisions: DataFrame) -> DataFrame:
    """Requirements a valid decision applies to, with the decision written in.

    ``decisions(tenant_id, project_id, id, decision, note, decided_at)``. Unknown keys give no row. Notes lose white
    space at both ends, Unicode's too, and may then have 1,000 UTF-16 units.
    """
    note = trim_ws(F.col("note"))
    valid = decisions.filter(
        F.col("decision").isin("confirmed", "rejected") & (F.coalesce(utf16_length(note), F.lit(0)) <= 1000)
    )
    return requirements.join(valid, ["tenant_id", "project_id", "id"]).select(
        "tenant_id", "project_id", "id", "code",
        F.col("decision").alias("confirmation_status"),
        F.when(F.col("note") != "", note).alias("confirmation_note"),
        F.col("decided_at").alias("confirmed_at"),
        F.col("decided_at").alias("updated_at"),
    )


def file_view(files: DataFrame, tasks: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """One row per file with its newest task; ``kept`` names further columns of the file to pass through."""
    newest = latest_task(tasks).withColumnRenamed("file_id", "id")
    task, parse = F.col("task"), F.col("parse_status")
    joined = files.join(newest, ["tenant_id", "id"], "left")
    status = (
        F.when((task["status"] == "failed") | (parse == "failed"), "error")
        .when((task["status"] == "succeeded") | (parse == "parsed"), "ready")
        .otherwise("parsing")
    )
    message = F.get_json_object(task["error"], "$.message")
    return joined.withColumn("status", status).select(
        "id", F.col("file_name").alias("name"), file_category(F.col("file_name")).alias("category"),
        file_size(F.col("size_bytes")).alias("size"), "status",
        F.date_format("updated_at", "MM-dd HH:mm").alias("updated_at"),
        task["id"].alias("task_id"), task["status"].alias("task_status"),
        F.coalesce(task["progress"], F.when(F.col("status") == "ready", 100)).cast("long").alias("progress"),
        message.alias("error"),
        F.coalesce(task["status"] == "failed", F.lit(False)).alias("can_retry"),
        *kept,
    )


def category_type(category: Column) -> Column:
    return F.coalesce(
        F.create_map(*[F.lit(v) for pair in fv.TYPE_BY_CATEGORY.items() for v in pair])[category],
        F.lit(fv.DEFAULT_TYPE),
    )


def requirement_view(requirements: DataFrame) -> DataFrame:
    """Labels, display percent and the anchor of each requirement by evidence kind."""
    kind = F.col("kind")
    by_id, by_index = F.col("paragraph_id").isNotNull(), F.format_string(fv.PARAGRAPH_INDEX, "paragraph_index")
    named = F.format_string(fv.PARAGRAPH_ID, "paragraph_id")
    sections = F.col("section_path")
    label = F.coalesce(
        F.when(kind == "pdf", F.format_string(fv.PAGE_ANCHOR, "page")),
        F.when(kind == "docx", F.when(by_id, named).otherwise(by_index)),
        F.when(kind == "txt", F.format_string(fv.LINE_ANCHOR, "line")),
        F.try_element_at(sections, F.lit(-1)), F.lit(fv.NO_ANCHOR),
    )
    paragraph = F.when(by_id, F.concat_ws(" · ", named, by_index)).otherwise(by_index)
    details = F.coalesce(
        F.when(kind == "pdf", F.format_string(fv.REGION_DETAIL, "page")),
        F.when(kind == "docx", F.format_string(fv.RANGE_DETAIL, paragraph, F.col("char_start"), F.col("char_end"))),
        F.when(kind == "txt", F.format_string(fv.TEXT_DETAIL, "line", "char_start", "line", "char_end")),
        F.when(F.size(sections) > 0, F.format_string(fv.SECTION_DETAIL, F.array_join(sections, " / "))), F.lit(""),
    )
    state = F.col("confirmation_status")
    return requirements.select(
        "id", "code", category_type(F.col("category")).alias("type"),
        (F.col("priority") == "mandatory").alias("mandatory"),
        F.when(kind != fv.FIXTURE_METHOD, percent(F.col("confidence"))).alias("confidence"),
        F.when(state == "confirmed", fv.TO_RESPOND).when(state == "rejected", fv.REJECTED)
        .otherwise(fv.UNCONFIRMED).alias("status"),
        (state == "confirmed").alias("confirmed"),
        F.when(kind == "pdf", F.col("page")).alias("page"),
        label.alias("anchor_label"), details.alias("anchor_details"),
    )


def newest_version(current: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Incoming rows replace current rows of the same key; the newest incoming version wins."""
    columns = current.columns
    stamped = current.withColumn("v", F.lit(0)).unionByName(incoming.withColumn("v", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    picked = stamped.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("v", "updated_at")).alias("row")
    )
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def bulk_assign(requirements: DataFrame, chosen: DataFrame, owner: str, section: str) -> DataFrame:
    """Requirements whose tenant and id are in ``chosen`` get owner and section and move to drafting."""
    picked = chosen.select("tenant_id", "id").distinct().withColumn("hit", F.lit(True))
    flagged = requirements.join(picked, ["tenant_id", "id"], "left")
    hit = F.coalesce("hit", F.lit(False))

    def put(name: str, value: str) -> Column:
        return F.when(hit, value).otherwise(F.col(name)).alias(name)

    return flagged.select(
        "id", put("owner", owner), put("section", section), put("status", fv.DRAFTING),
        (hit | F.col("confirmed")).alias("confirmed"),
    )


def confirmed_status(status: Column, confirm_it: Column) -> Column:
    """Confirming moves only unconfirmed rows; rejecting moves every row back."""
    kept = F.when(status == fv.UNCONFIRMED, fv.TO_RESPOND).otherwise(status)
    return F.when(confirm_it, kept).otherwise(fv.UNCONFIRMED)

