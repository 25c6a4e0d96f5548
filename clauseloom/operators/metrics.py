"""Counts, facets, searches, gates and operations metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv
from clauseloom.functions.formats import half_up, percent


def rate(part: Column, whole: Column) -> Column:
    """Whole percent of ``part`` in ``whole``; an empty whole counts as one."""
    return half_up(part * 100 / F.greatest(F.lit(1).cast("long"), whole))


def confirmation_counts(requirements: DataFrame, *keys: str) -> DataFrame:
    """One pass; a NULL confidence is not low."""
    state, low = F.col("confirmation_status"), percent(F.col("confidence")) < fv.LOW_CONFIDENCE
    return requirements.groupBy(*keys).agg(
        *[F.count_if(state == s).alias(s) for s in ("pending", "confirmed", "rejected")],
        F.count_if(F.col("priority") == "mandatory").alias("mandatory"),
        F.count_if(low).alias("low_confidence"),
        F.countDistinct("source").alias("sources"),
    )


def facets(df: DataFrame, column: str, total_label: str = "全部") -> DataFrame:
    """Count per value plus one total row."""
    return (
        df.rollup(column)
        .agg(F.count("*").alias("n"), F.grouping(column).alias("is_total"))
        .select(F.when(F.col("is_total") == 1, total_label).otherwise(F.col(column)).alias(column), "n")
    )


def matches(keyword: str, *parts: str | Column) -> Column:
    """Caseless literal substring over the joined columns; ``%`` and ``_`` are plain characters."""
    needle = keyword.strip().lower()
    if not needle:
        return F.lit(True)
    return F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(needle))


def any_matches(keyword: str, *columns: str) -> Column:
    needle = keyword.strip().lower()
    if not needle:
        return F.lit(True)
    tests = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle)) for c in columns]
    return reduce(lambda a, b: a | b, tests)


def deadlines_within(projects: DataFrame, now: Column, days: int = 7) -> DataFrame:
    span = F.make_dt_interval(F.lit(days))
    due = projects.filter((F.col("status") != "archived") & F.col("deadline").between(now, now + span))
    return due.groupBy("tenant_id").agg(F.count("*").alias("due"), F.min("deadline").alias("nearest"))


def file_status_counts(files: DataFrame, *keys: str) -> DataFrame:
    return files.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ready", "parsing", "error")],
        F.coalesce(F.sum(F.col("pages").try_cast("long")), F.lit(0)).cast("long").alias("pages"),
    )


def coverage(requirements: DataFrame, *keys: str) -> DataFrame:
    """Share of confirmed requirements that are mapped; 0 when none is confirmed."""
    confirmed, unmapped = F.col("confirmed"), F.col("section") == fv.UNMAPPED
    counted = requirements.groupBy(*keys).agg(
        F.count_if(confirmed).alias("confirmed"),
        F.count_if(confirmed & unmapped).alias("unmapped"),
        F.count_if(confirmed & unmapped & F.col("mandatory")).alias("unmapped_mandatory"),
        F.count_if(F.col("risk").isin(fv.BLOCKER, "高")).alias("high_risk"),
    )
    share = half_up((F.col("confirmed") - F.col("unmapped")) * 100 / F.col("confirmed"))
    return counted.withColumn(
        "coverage", F.when(F.col("confirmed") == 0, F.lit(0).cast("long")).otherwise(share)
    )


def overview(files: DataFrame, requirements: DataFrame, outline: DataFrame, issues: DataFrame) -> DataFrame:
    """Per project: four independent partial aggregates, then joined on the project key."""
    project = "project_id"
    file_part = files.groupBy(project).agg(
        F.count_if(F.col("status") == "ready").alias("ready_files"),
        F.count_if(F.col("status") == "error").alias("error_files"),
    )
    requirement_part = requirements.groupBy(project).agg(
        F.count("*").alias("requirements"),
        F.count_if("confirmed").alias("confirmed"),
        F.count_if(F.col("section") != fv.UNMAPPED).alias("mapped"),
    )
    outline_part = outline.groupBy(project).agg(
        F.count("*").alias("chapters"),
        F.count_if(F.col("status") == fv.SECTION_APPROVED).alias("approved"),
    )
    still_open = F.col("status") == fv.OPEN_ISSUE
    issue_part = issues.groupBy(project).agg(
        F.count_if(still_open).alias("open_issues"),
        F.count_if(still_open & (F.col("severity") == fv.BLOCKER)).alias("blockers"),
    )
    parts = (file_part, requirement_part, outline_part, issue_part)
    joined = reduce(lambda a, b: a.join(b, project, "full"), parts)

    def n(name: str) -> Column:
        return F.coalesce(name, F.lit(0).cast("long"))

    plain = ("ready_files", "error_files", "confirmed", "mapped", "approved", "open_issues", "blockers")
    return joined.select(
        project, *[n(c).alias(c) for c in plain],
        rate(n("confirmed"), n("requirements")).alias("confirmation_rate"),
        rate(n("mapped"), n("requirements")).alias("mapping_rate"),
        rate(n("approved"), n("chapters")).alias("chapter_rate"),
    )


def export_gates(requirements: DataFrame, issues: DataFrame, outline: DataFrame) -> DataFrame:
    """Six named gates per project with the number that blocks each; ``formal_export`` needs all."""
    project = "project_id"
    must = F.col("mandatory")
    requirement_part = requirements.groupBy(project).agg(
        F.count_if(must & ~F.col("confirmed")).alias("unconfirmed_mandatory"),
        F.count_if(must & (F.col("section") == fv.UNMAPPED)).alias("unmapped_mandatory"),
    )
    issue_part = issues.groupBy(project).agg(
        F.count_if((F.col("severity") == fv.BLOCKER) & (F.col("status") == fv.OPEN_ISSUE)).alias("open_blockers")
    )
    outline_part = outline.groupBy(project).agg(
        F.count_if(F.col("frozen") == F.lit(False)).alias("outline_not_frozen"),
        F.count_if((F.col("level") == 1) & (F.col("status") != fv.SECTION_APPROVED)).alias("sections_not_approved"),
    )
    joined = requirement_part.join(issue_part, project, "full").join(outline_part, project, "full")
    gates = (
        "unconfirmed_mandatory", "unmapped_mandatory", "outline_not_frozen", "open_blockers",
        "sections_not_approved",
    )
    counts = joined.select(
        project, *[F.coalesce(g, F.lit(0).cast("long")).alias(g) for g in gates],
        F.lit(0).cast("long").alias("template_errors"),
    )
    every = (*gates, "template_errors")
    failing = reduce(lambda a, b: a + b, [(F.col(g) > 0).cast("long") for g in every])
    return (
        counts.withColumn("failing_gates", failing)
        .withColumn("formal_export", F.col("failing_gates") == 0)
        .unpivot([project, "failing_gates", "formal_export"], list(every), "gate", "blocking")
        .withColumn("passed", F.col("blocking") == 0)
    )


def approval_gate(sections: DataFrame, issues: DataFrame) -> DataFrame:
    """A submitted section may be approved when its project has no open blocker."""
    blockers = (
        issues.filter((F.col("status") == fv.OPEN_ISSUE) & (F.col("severity") == fv.BLOCKER))
        .groupBy("project_id")
        .agg(F.count("*").alias("blockers"))
    )
    submitted = F.col("status") == fv.SECTION_IN_REVIEW
    blocked = F.coalesce("blockers", F.lit(0)) > 0
    return sections.join(blockers, "project_id", "left").select(
        "id", "project_id",
        F.when(~submitted, "NOT_SUBMITTED").when(blocked, "OPEN_BLOCKER").otherwise("APPROVABLE").alias("gate"),
    )


def section_label() -> Column:
    return F.concat("number", F.lit(" "), "title")


def section_requirements(outline: DataFrame, requirements: DataFrame) -> DataFrame:
    """Requirements of each section: equal project and label."""
    labelled = outline.select("project_id", section_label().alias("section"), F.col("id").alias("section_id"))
    return requirements.join(labelled, ["project_id", "section"])


def section_requirement_counts(outline: DataFrame, requirements: DataFrame) -> DataFrame:
    """Requirements are counted per label before the join, so only one row per label moves."""
    counted = requirements.groupBy("project_id", "section").agg(F.count("*").alias("n"))
    labelled = outline.withColumn("section", section_label())
    return labelled.join(counted, ["project_id", "section"], "left").select(
        "id", "section", F.coalesce("n", F.lit(0).cast("long")).alias("requirements")
    )


def section_issues(outline: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues whose location contains the section's number or title, within a project.

    Substring tests become an equi-join on the whole number or title: a location offers its substrings of just
    the lengths that its project's keys have. A pair that meets is a hit, so keys that begin alike do not meet
    each other's locations.
    """
    keys = outline.select(
        "project_id", F.col("id").alias("section_id"), F.explode(F.array("number", "title")).alias("key")
    ).filter(F.col("key").isNotNull()).distinct()
    lengths = keys.groupBy("project_id").agg(F.collect_set(F.length("key")).alias("lengths"))

    def substrings(size: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length("location") - size + 1, F.lit(1)))
        return F.transform(places, lambda at: F.substring(F.col("location"), at, size))

    located = issues.join(lengths, "project_id").select(
        "project_id", F.col("id").alias("issue_id"),
        F.explode(F.array_distinct(F.flatten(F.transform("lengths", substrings)))).alias("key"),
    )
    return located.join(keys, ["project_id", "key"]).select("section_id", "issue_id").distinct()


def chapter_progress(outline: DataFrame) -> DataFrame:
    return outline.groupBy("project_id").agg(
        F.count_if(F.col("status") == fv.SECTION_APPROVED).alias("approved"),
        F.count("*").alias("chapters"),
        F.count_if(F.col("level") == 2).alias("section_options"),
    )


def evidence_mix(requirements: DataFrame) -> DataFrame:
    counted = requirements.groupBy("project_id").agg(
        F.count_if(F.col("kind").isin("pdf", "docx", "txt")).alias("real"),
        F.count_if(F.col("kind") == fv.FIXTURE_METHOD).alias("fixture"),
    )
    real, fixture = F.col("real") > 0, F.col("fixture") > 0
    return counted.withColumn(
        "notice",
        F.when(real & fixture, "mixed").when(real, "real").when(fixture, "fixture").otherwise("none"),
    )


def task_latency(tasks: DataFrame) -> DataFrame:
    """Queue and run minutes per tenant, type and hour of creation: counts and exact percentiles.

    ``percentile`` keeps a value→count histogram: durations are whole minutes, so its size is the
    number of distinct durations, not the number of tasks.
    """
    def minutes(start: str, end: str) -> Column:
        return F.timestamp_diff("MINUTE", F.col(start), F.col(end))

    timed = tasks.select(
        "tenant_id", "type", F.date_format("created_at", "yyyy-MM-dd HH").alias("hour"),
        minutes("created_at", "started_at").alias("queued"), minutes("started_at", "finished_at").alias("ran"),
    )
    shares = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))

    def spread(name: str) -> list[Column]:
        return [F.percentile(name, shares)[i].alias(f"{name}_p{p}") for i, p in enumerate((50, 95, 99))]

    return timed.groupBy("tenant_id", "type", "hour").agg(
        F.count("queued").alias("started"), F.count("ran").alias("finished"), *spread("queued"), *spread("ran")
    )


def task_outcomes(tasks: DataFrame, now: Column) -> DataFrame:
    """Per tenant and type with subtotals (NULL = all)."""
    lost = (F.col("status") == "running") & (F.col("lease_expires_at") <= now)
    counted = tasks.rollup("tenant_id", "type").agg(
        F.count("*").alias("tasks"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum(F.greatest(F.col("attempt") - 1, F.lit(0).cast("long"))).alias("retries"),
        F.count_if(lost).alias("lease_lost"),
        F.count("dead_lettered_at").alias("dead_letters"),
    )
    ended = F.col("succeeded") + F.col("failed")
    return counted.withColumn(
        "success_rate", F.when(ended > 0, F.round(F.col("succeeded") / ended, 6))
    )


def outbox_backlog(outbox: DataFrame, now: Column) -> DataFrame:
    waiting = F.col("published_at").isNull()
    return outbox.groupBy("tenant_id").agg(
        F.count_if(waiting).alias("unpublished"),
        F.count_if(waiting & (F.col("available_at") <= now)).alias("due"),
        F.timestamp_diff("MINUTE", F.min(F.when(waiting, F.col("created_at"))), now).alias("oldest_minutes"),
        # Being published right now, and waiting for a publisher.
        F.count_if(waiting & (F.col("lease_expires_at") > now)).alias("pending"),
        F.count_if(
            waiting & (F.col("available_at") <= now) & (F.col("lease_owner").isNull() | (F.col("lease_expires_at") <= now))
        ).alias("idle"),
        F.round(F.avg((F.col("publish_attempts") > 1).cast("double")), 6).alias("retry_share"),
        F.max("publish_attempts").alias("most_attempts"),
    )


def parser_quality(requirements: DataFrame) -> DataFrame:
    located = F.col("kind").isin("pdf", "docx", "txt")
    return requirements.groupBy("extraction_method", "category").agg(
        F.count("*").alias("requirements"),
        F.round(F.avg(located.cast("double")), 6).alias("located_share"),
        F.round(F.avg((F.col("confirmation_status") == "rejected").cast("double")), 6).alias("rejected_share"),
        F.round(F.avg((F.col("confirmation_status") != "pending").cast("double")), 6).alias("reviewed_share"),
    )
