"""Corpus checks: duplicates, placeholders, consistency, orphans, stage transitions, assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clauseloom.functions.text import let
from clauseloom.session import materialize

# --- Fixed values: placeholder form and allowed stage transitions ------------------------------
PLACEHOLDER = r"【[^【】]*待[^【】]*】"
STAGE_TRANSITIONS = (
    ("DRAFT", "ANALYZING"), ("ANALYZING", "PLANNING"), ("PLANNING", "WRITING"), ("WRITING", "REVIEWING"),
    ("REVIEWING", "APPROVED"), ("APPROVED", "ARCHIVED"), ("ANALYZING", "DRAFT"),
    ("REVIEWING", "WRITING"), ("APPROVED", "WRITING"), ("ARCHIVED", "WRITING"),
)


def duplicate_files(files: DataFrame) -> DataFrame:
    """Same digest within a tenant: one row per group, counted before the shuffle."""
    grouped = files.groupBy("tenant_id", "sha256").agg(
        F.count("*").alias("copies"), F.min("id").alias("first_id")
    )
    return grouped.filter("copies > 1")


def placeholders(sections: DataFrame, text: str = "content") -> DataFrame:
    found = F.regexp_count(text, F.lit(PLACEHOLDER))
    return sections.filter(F.contains(text, F.lit("【"))).select(
        "id", "project_id", found.cast("long").alias("placeholders")
    ).filter("placeholders > 0")


def inconsistent_fields(rows: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Fields that take more than one value within a key.

    min <> max tells as much as a distinct count and keeps two values per group, however many rows.
    """
    stats = []
    for name in fields:
        text = F.col(name).cast("string")
        stats += [F.min(text).alias(f"{name}_low"), F.max(text).alias(f"{name}_high")]
    grouped = rows.groupBy(*keys).agg(*stats)
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("field"), F.col(f"{n}_low").alias("low"), F.col(f"{n}_high").alias("high"))
            for n in fields
        ]
    )
    return grouped.select(*keys, F.inline(pairs)).filter("low <> high")


def object_reconciliation(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """Object inventory against file rows, by object key."""
    rows = files.filter("object_key IS NOT NULL").select("object_key", "id", F.col("object_etag").alias("row_etag"))
    both = inventory.join(rows, "object_key", "full")
    status = (
        F.when(F.col("id").isNull(), "orphan_object")
        .when(F.col("etag").isNull(), "missing_object")
        .when(F.col("etag") != F.col("row_etag"), "etag_mismatch")
        .otherwise("ok")
    )
    return both.select("object_key", "id", status.alias("status")).filter("status <> 'ok'")


def forbidden_transitions(audit: DataFrame, allowed: tuple[tuple[str, str], ...] = STAGE_TRANSITIONS) -> DataFrame:
    """Consecutive stages of an entity that are not on the list. The list is a literal in the plan."""
    order = W.partitionBy("entity_id").orderBy("ts", "seq")
    steps = audit.withColumn("from_stage", F.lag("stage").over(order))
    move = F.concat_ws(">", "from_stage", "stage")
    known = move.isin(*[">".join(pair) for pair in allowed]) | (F.col("from_stage") == F.col("stage"))
    return steps.filter(F.col("from_stage").isNotNull() & ~known).select(
        "entity_id", "seq", "from_stage", F.col("stage").alias("to_stage")
    )


def available_assets(assets: DataFrame, at: Column) -> DataFrame:
    """Available, approved and inside their validity; an open end is unlimited."""
    valid = (
        (F.col("status") == "AVAILABLE")
        & (F.col("approval_status") == "APPROVED")
        & (F.coalesce(F.col("effective_at") <= at, F.lit(True)))
        & (F.coalesce(F.col("expires_at") > at, F.lit(True)))
    )
    return assets.filter(valid).select("id", "name", "expires_at")


# --- near-duplicate content ---------------------------------------------------------------------

SHINGLE = 3
# A token is one ideograph or one run of other non-space characters.
TOKEN = r"[\p{IsHan}]|[^\s\p{IsHan}]+"


def _shingles(text: Column) -> Column:
    """Distinct hashes of three consecutive tokens; a shorter text is a single shingle."""

    def windows(tokens: Column) -> Column:
        last = F.greatest(F.size(tokens) - SHINGLE + 1, F.lit(1))
        return F.transform(
            F.sequence(F.lit(0), last - 1),
            lambda at: F.xxhash64(*[F.coalesce(F.get(tokens, at + k), F.lit("")) for k in range(SHINGLE)]),
        )

    return F.array_distinct(let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), windows))


def _jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    first, second = (
        sets.select(F.col("id").alias(k), F.col("size").alias(f"size_{k}"), F.col("items").alias(f"items_{k}")) for k in ("a", "b")
    )
    both = pairs.join(first, "a").join(second, "b")
    # What only one text has is in its size, and in no intersection.
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.select("a", "b", (common / (F.col("size_a") + F.col("size_b") - common)).alias("similarity"))


def duplicate_content(sections: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``sections(id, text)`` → distinct texts, their copies, and whether another text exceeds the
    similarity threshold (Jaccard of token shingles).

    Exact, and linear in a group of look-alikes: equal texts collapse first; two sets can exceed
    the threshold only when they share one of the rarest shingles of each, so those alone become
    join keys; within such a key every text is compared with the key's first text, and only texts
    still without a partner meet the other members.
    """
    content = sections.groupBy(F.sha2("text", 256).alias("digest")).agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("text").alias("text")
    )
    # Counted where they lie: a shingle crosses once with its text's id, and those of one text only go no further.
    shingled = content.select("id", _shingles(F.col("text")).alias("items"))
    items = shingled.select("id", F.size("items").alias("size"), F.explode("items").alias("item"))
    shared = items.withColumn("n", F.count("*").over(W.partitionBy("item"))).filter("n > 1")
    packed = shared.groupBy("id").agg(
        F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "item"))).alias("found")
    )
    sets = materialize(packed.select("id", "size", F.transform("found", lambda f: f["item"]).alias("items")), "shared-shingles")

    # More than t·|x| common items are impossible unless the rarest |x| - ceil(t·|x|) + 1 meet. Shingles of one text only are its
    # rarest, so they come first and are left out of the others' places.
    prefix = F.size("items") - F.ceil(F.col("size") * threshold) + 1
    keyed = sets.filter(prefix > 0).select("id", "size", F.explode(F.slice("items", F.lit(1), prefix.cast("int"))).alias("item"))
    keyed = materialize(keyed, "rare-shingles")

    leaders = keyed.groupBy("item").agg(F.min("id").alias("a"))
    to_leader = keyed.join(leaders, "item").filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    near = _jaccard(to_leader, sets).filter(F.col("similarity") > threshold)
    paired = materialize(
        near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired-sections"
    )

    alone = keyed.join(paired, "id", "left_anti").select(
        F.col("id").alias("a"), F.col("size").alias("size_a"), "item"
    )
    others = keyed.select(F.col("id").alias("b"), F.col("size").alias("size_b"), "item")
    rest = (
        alone.join(others, "item")
        .filter(
            (F.col("a") != F.col("b"))
            & (F.col("size_b") >= F.col("size_a") * threshold)
            & (F.col("size_a") >= F.col("size_b") * threshold)
        )
        .select("a", "b")
        .distinct()
    )
    late = _jaccard(rest, sets).filter(F.col("similarity") > threshold).select(F.col("a").alias("id"))
    similar = paired.union(late).distinct().withColumn("similar", F.lit(True))
    texts = sections.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return texts.join(similar, "id", "left").select(
        "id", "copies", F.coalesce("similar", F.lit(False)).alias("similar")
    )
