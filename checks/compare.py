"""Run registered queries against their SQL and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.catalog import CHECKS, session_for


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return connection


def _cell(value):
    """Comparable value; types are kept apart, doubles are compared to nine digits."""
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value


def _kind(value) -> str:
    for kind in (bool, int, float, decimal.Decimal, str, dt.datetime, dt.date):
        if isinstance(value, kind):
            return kind.__name__
    return type(value).__name__


def _rows(columns: list[str], rows) -> tuple[list[tuple], dict[str, set[str]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    ordered = [tuple(_cell(row[i]) for i in order) for row in rows]
    kinds = {
        columns[i]: {_kind(row[p]) for row in ordered if row[p] is not None}
        for p, i in enumerate(order)
    }
    return sorted(ordered, key=lambda row: [(v is not None, str(v)) for v in row]), kinds


def compare(spark: SparkSession, connection, folder: str, name: str) -> list[str]:
    """Differences between the two sides of a query; empty if they agree."""
    check = CHECKS[name]
    ours = check.plan(session_for(spark, folder))
    rows = ours.collect()
    answer = connection.execute(check.sql)
    names = [d[0] for d in answer.description]
    if sorted(ours.columns) != sorted(names):
        return [f"columns {sorted(ours.columns)} and {sorted(names)}"]
    left, left_kinds = _rows(ours.columns, rows)
    right, right_kinds = _rows(names, answer.fetchall())
    problems = []
    if not left:
        problems.append("no rows")
    if len(left) != len(right):
        problems.append(f"{len(left)} and {len(right)} rows")
    kinds = {c: (k, right_kinds[c]) for c, k in left_kinds.items() if k != right_kinds[c]}
    if kinds:
        problems.append(f"kinds {kinds}")
    if left != right:
        differing = [(a, b) for a, b in zip(left, right) if a != b]
        problems.append(f"{len(differing)} differing rows, first {differing[:2]}")
    return problems


def main(folder: str, names: list[str]) -> None:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in names or CHECKS:
        started = time.time()
        try:
            problems = compare(spark, connection, folder, name)
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok'} {name} {time.time() - started:.2f}s", *problems,
              sep=" | ", flush=True)
    print(f"{failed} of {len(names or CHECKS)} failed")


if __name__ == "__main__":
    import sys

    main(sys.argv[1], sys.argv[2:])
