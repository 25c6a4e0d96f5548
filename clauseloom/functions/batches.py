"""Bounds on what a Python worker holds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

_BATCH_SETTING, _UNSET, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes for rows as long as documents and blocks, unless the session says otherwise: a
    Python worker holds several times its batch, and an executor several workers."""
    if spark.conf.get(_BATCH_SETTING, _UNSET) == _UNSET:
        spark.conf.set(_BATCH_SETTING, _BATCH_BYTES)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(function: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """An Arrow function that gives freed memory back to the system after each batch. Allocators keep it otherwise, and a Python worker is used
    again by later stages, so that an executor would hold the peaks of all stages at once."""

    @wraps(function)
    def run(*columns: pa.Array) -> pa.Array:
        made = function(*columns)
        release_memory()
        return made

    return run
