from __future__ import annotations

import datetime as dt
import random

import pytest

from laurel.sources.calendar import Calendar
from small import domain, term_start, terms


def test_current_term_and_cutoffs(spark):
    calendar = Calendar.load(domain(spark, terms=terms(19900, 20023)), dt.date(2001, 9, 1))
    assert calendar.current_term == 20013
    assert calendar.years_back(6) == 19953
    assert calendar.award_cutoff(6) == 19952
    assert calendar.current_academic_year == 20012002


def test_current_term_is_the_one_of_its_college(spark):
    rows = terms(20000, 20012) + [(20013, "W", term_start(20013))]
    calendar = Calendar.load(domain(spark, terms=rows), dt.date(2001, 9, 1))
    assert calendar.current_term == 20012


def test_no_started_term(spark):
    with pytest.raises(ValueError):
        Calendar.load(domain(spark, terms=terms(20100, 20103)), dt.date(2001, 9, 1))


@pytest.mark.parametrize("seed", range(3))
def test_as_of_term_equals_maximum_over_started_terms(spark, seed):
    """Also with starts that disagree with codes, shared starts and gaps of years."""
    source = random.Random(seed)
    codes = source.sample([t for t in range(19800, 20050) if t % 10 < 4], 25)
    rows = []
    for code in codes:
        base = term_start(code) if source.random() < 0.7 else term_start(source.choice(codes))
        rows.append((code, "E", base))
        if source.random() < 0.3:
            rows.append((code, "W", base + dt.timedelta(days=source.randint(-40, 40))))
    tables = domain(spark, terms=rows)
    calendar = Calendar.load(tables, dt.date(2060, 1, 1))
    days = [dt.date(1979, 1, 1) + dt.timedelta(days=source.randint(0, 11000)) for _ in range(300)]
    days += [r[2] for r in rows] + [dt.date(2400, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    found = {r["day"]: r["term"] for r in calendar.with_term_as_of(df, "day", "term").collect()}
    starts = {}
    for code, _, start in rows:
        starts[code] = min(start, starts.get(code, start))
    for day in days:
        assert found[day] == max((c for c, s in starts.items() if s <= day), default=None)

    low, high = sorted(source.sample(codes, 2))
    inside = df.where(calendar.date_within_terms("day", low, high)).distinct().collect()
    assert {r["day"] for r in inside} == {
        d for d in days if found[d] is not None and low <= found[d] <= high}


def test_one_row_per_input_row(spark):
    calendar = Calendar.load(domain(spark, terms=terms(19900, 20013)), dt.date(2001, 9, 1))
    df = spark.createDataFrame([(dt.date(1990, 1, 1),), (None,), (dt.date(1980, 1, 1),)], "day date")
    rows = calendar.with_term_as_of(df, "day", "term").collect()
    assert sorted(str(r["term"]) for r in rows) == ["19900", "None", "None"]
