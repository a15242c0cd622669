"""A small domain written by hand; tables left out are empty."""

from __future__ import annotations

import datetime as dt

from laurel.sources.domain import SCHEMAS, Domain

STARTS = {0: (1, 1), 1: (2, 5), 2: (6, 10), 3: (8, 25)}


def term_start(term: int) -> dt.date:
    return dt.date(term // 10, *STARTS[term % 10])


def day_in(term: int) -> dt.date:
    return term_start(term) + dt.timedelta(days=3)


def terms(first: int, last: int, college: str = "E") -> list[tuple]:
    return [(t, college, term_start(t)) for t in range(first, last + 1) if t % 10 < 4]


def domain(spark, **tables) -> Domain:
    """Rows per table as tuples in schema order, or as dicts with only some columns."""
    frames = {}
    for name, schema in SCHEMAS.items():
        rows = [
            tuple(row.get(c) for c in schema.names) if isinstance(row, dict) else row
            for row in tables.get(name, [])
        ]
        frames[name] = spark.createDataFrame(rows, schema)
    return Domain.from_frames(spark, **frames)


def dicts(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]
