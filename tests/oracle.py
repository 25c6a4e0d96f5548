"""Runs catalogue queries on Spark and on DuckDB and reports differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from clauseloom.sources.derived import BASE_TABLES

_TYPES = {
    "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return "\x00null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if abs(value) < 1e-4 else repr(round(value, 6) + 0.0)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types, row count and values (empty when equal)."""
    relation = con.sql(sql)
    names, kinds = list(relation.columns), [str(t) for t in relation.types]
    spark_types = dict(df.dtypes)
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in zip(names, kinds, strict=True):
        if _TYPES.get(spark_types[name]) != kind:
            problems.append(f"type of {name}: {spark_types[name]} vs {kind}")
    left = _rows(df.columns, df.collect())
    right = _rows(names, relation.fetchall())
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    if left != right:
        only_left, only_right = set(left) - set(right), set(right) - set(left)
        problems.append(
            f"values differ: {len(only_left)} only in Spark e.g. {sorted(only_left)[:2]}; "
            f"{len(only_right)} only in oracle e.g. {sorted(only_right)[:2]}"
        )
    if not left:
        problems.append("empty result")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as api
    from clauseloom.session import build_session

    sf_dir, wanted = argv[0], argv[1:]
    spark, con = build_session(**{"spark.ui.showConsoleProgress":"false"}), connect(sf_dir)
    oracles, bad = api.oracle_sql(), 0
    for name, fn in api.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                spark_start = time.time()
                problems = compare(df, con, oracles[name])
            else:
                count = df.count()
                problems = [] if count else ["empty result"]
        except Exception as error:  # report and go on
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        took = time.time() - start
        mark = "ok  " if not problems else "FAIL"
        bad += bool(problems)
        print(f"{mark} {took:6.2f}s {name}{'' if name in oracles else ' (rows only)'}", flush=True)
        for problem in problems:
            print("      ", problem[:1800], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
