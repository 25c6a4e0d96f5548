"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.batches import bounded_batches, release_memory, tidy  # noqa: F401

#: A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have yet, whatever extra columns it carries."""
    taken = {name.lower() for name in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_slices(texts: pa.Array, chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``chars`` characters with the position of the first; a null reads as empty.

    An Arrow batch holds whatever its rows hold; what a step makes of the texts is larger than they are,
    so steps work through a batch in runs of bounded size (one text longer than that is a run alone).
    """
    run, size, first = [], 0, 0
    for at in range(len(texts)):
        text = texts[at].as_py() or ""
        if run and size + len(text) > chars:
            yield first, run
            run, size, first = [], 0, at
        run.append(text)
        size += len(text)
    if run:
        yield first, run
