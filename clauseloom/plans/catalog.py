"""The catalogue of named queries.

``@entry("name", ctes, sql)`` registers a callable ``(spark, sf_dir) -> DataFrame`` and, where SQL
can express it, the oracle text. Oracle fragments shared by several queries are common table
expressions listed in ``oracle_parts``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.plans.oracle_parts import PARTS

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def with_ctes(names: Iterable[str], body: str) -> str:
    """``WITH`` clause holding ``names`` and everything they depend on, each once."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name not in PARTS:
            return
        for parent in PARTS[name][0]:
            visit(parent)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    head = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in ordered)
    return f"WITH {head}\n{body}"


def plain(df: DataFrame) -> DataFrame:
    """Report types: whole numbers as bigint, decimals as double, times as text, lists joined."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.IntegerType | T.ShortType | T.ByteType):
            column = column.cast("long")
        elif isinstance(kind, T.DecimalType | T.FloatType):
            column = column.cast("double")
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            column = F.array_join(column, "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def entry(name: str, ctes: Iterable[str] = (), sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(ctes, sql)
        return fn

    return register
