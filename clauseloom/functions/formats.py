"""Display formats and bands of the analyst screens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions import fixed_values as fv


def half_up(value: Column) -> Column:
    """Round half up to a whole number (the screens' rule for percentages)."""
    return F.floor(value + 0.5).cast("long")


def file_size(size: Column) -> Column:
    kib, mib = 1024, 1024 * 1024
    # Tenths are exact integers here: half-up on the scaled value, then split at the point.
    tenths = F.floor(size / mib * 10 + 0.5).cast("long")
    return (
        F.when(size < kib, F.concat(size.cast("string"), F.lit(" B")))
        .when(
            size < mib,
            F.concat(F.greatest(F.lit(1).cast("long"), half_up(size / kib)).cast("string"), F.lit(" KB")),
        )
        .otherwise(
            F.concat(
                F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB")
            )
        )
    )


def file_category(file_name: Column, packages: bool = False) -> Column:
    """Class by extension; ``packages`` adds the two classes only the upload screen knows."""
    extension = F.lower(F.substring_index(file_name, ".", -1))
    labels = fv.CATEGORY_BY_EXTENSION | (fv.PACKAGE_BY_EXTENSION if packages else {})
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(known[extension], F.lit(fv.DEFAULT_FILE_CATEGORY))


def confidence_band(percent: Column) -> Column:
    return (
        F.when(percent < fv.LOW_CONFIDENCE, "confidence-low")
        .when(percent < 93, "confidence-medium")
        .when(percent.isNotNull(), "confidence-high")
    )


def risk_band(risks: Column) -> Column:
    return F.when(risks >= 10, "red").when(risks >= 5, "amber").when(risks.isNotNull(), "green")


def coverage_band(coverage: Column) -> Column:
    return F.when(coverage < 80, "amber").when(coverage.isNotNull(), "green")


def short_time(value: Column) -> Column:
    """``MM-dd HH:mm``; text that is no timestamp passes through."""
    parsed = F.try_to_timestamp(value).cast("timestamp_ntz")
    return F.coalesce(F.date_format(parsed, "MM-dd HH:mm"), value)


def percent(confidence: Column) -> Column:
    return half_up(confidence * 100)
