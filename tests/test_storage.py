"""Tables stored by what they are joined on, and reports refreshed by term."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import Path

import pytest

import laurel
from checks.catalog import SPLITS
from laurel.operators.selection import ACADEMIC_YEAR, AWARD_TERM
from laurel.plans import datasets as D
from laurel.sources.domain import BY_SECTION, Domain
from small import day_in, dicts, domain, terms
from test_groups_and_modes import hot_tables

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def bucketed(spark):
    spark.sql("create database if not exists stored")
    laurel.derive_domain(spark, FOLDER).save_tables("stored", 4)
    yield Domain.from_tables(spark, "stored")
    spark.sql("drop database stored cascade")


def section_join(df):
    """The part of the plan that makes the join with the sections."""
    plan = df._jdf.queryExecution().executedPlan()
    open_nodes = [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while open_nodes:
        node = open_nodes.pop()
        if "Join" in node.nodeName() and re.match(r"\w+ \[Section_Number", node.simpleString(1000)):
            return node.toString()
        open_nodes += [node.children().apply(i) for i in range(node.children().size())]
    raise AssertionError("no section join")


@pytest.mark.parametrize("name, build", [
    ("course_takers", laurel.course_takers), ("efficiency", laurel.efficiency),
    ("top", lambda d, c: laurel.top_program_courses(d, c, "000100", "AA"))])
def test_sections_are_joined_where_they_lie(spark, bucketed, name, build):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        calendar = laurel.Calendar.load(bucketed, dt.date(2001, 9, 1))
        stored = build(bucketed, calendar)
        plan = section_join(stored)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert plan.count(BY_SECTION) and "sections2" in plan
        derived = build(laurel.derive_domain(spark, FOLDER), calendar)
        assert "Exchange" in section_join(derived)

        def tidy(df):
            return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)

        assert tidy(stored) == tidy(derived) != []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables_without_the_copy_by_section(spark, bucketed):
    spark.sql("create database if not exists plain")
    try:
        for name in laurel.SCHEMAS:
            spark.table(f"stored.{name}").write.mode("overwrite").saveAsTable(f"plain.{name}")
        tables = Domain.from_tables(spark, "plain")
        assert tables.by_section is None and bucketed.by_section is not None
        assert laurel.awards_all(tables, laurel.Calendar.load(tables, dt.date(2001, 9, 1))).count() > 0
    finally:
        spark.sql("drop database plain cascade")


def files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def partition_terms(paths):
    return {int(p.parts[0].split("=")[1]) for p in paths}


@pytest.mark.parametrize("period", [ACADEMIC_YEAR, AWARD_TERM])
@pytest.mark.parametrize("mode", list(SPLITS))
def test_refresh_equals_a_full_run(spark, tmp_path, period, mode):
    """One more term, and late rows of an earlier one; other partitions keep their files."""
    tables = hot_tables(spark)
    late = (tables.awards["Award_Date"] < str(day_in(19982))) & (tables.awards["Award_Date"] >= str(day_in(19980))) \
        & (tables.awards["Student_Id"] % 3 == 0)
    old = tables.awards.where((tables.awards["Award_Date"] < "2000-08-01") & ~late)
    new = tables.awards.where((tables.awards["Award_Date"] >= "2000-08-01") | late)
    frames = {name: tables[name] for name in laurel.SCHEMAS}
    earlier = Domain.from_frames(spark, **{**frames, "awards": old})
    store = laurel.CompleterStore(spark, str(tmp_path / "cells"))
    store.build(earlier, laurel.Calendar.load(earlier, dt.date(2000, 8, 1)))
    first = files(store.path)
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    counted = store.refresh(tables, calendar, new, 20002)
    again = files(store.path)
    kept = {p for p in first if first[p] == again.get(p)}
    assert partition_terms(kept) == partition_terms(first) - set(counted) != set()
    assert set(counted) >= {20003, 20010, 20011, 20012, 20013} and {19980, 19981} & set(counted)
    report = store.report(calendar, period, SPLITS[mode])
    full = laurel.report_completers({"all": laurel.awards_all(tables, calendar, details=(D.STUDENT,))}, period, SPLITS[mode])
    assert sorted(map(str, dicts(report.select(full.columns)))) == sorted(map(str, dicts(full))) != []


def test_nothing_new_leaves_all_files(spark, tmp_path):
    tables = hot_tables(spark)
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    store = laurel.CompleterStore(spark, str(tmp_path / "cells"))
    store.build(tables, calendar)
    before = files(store.path)
    assert store.refresh(tables, calendar, tables.awards.limit(0), calendar.current_term) == []
    assert files(store.path) == before
    running = dicts(store.report(calendar, cumulative=True))
    full = dicts(laurel.report_completers({"all": laurel.awards_all(tables, calendar, details=())}, cumulative=True))
    assert sorted(map(str, running)) == sorted(map(str, full))


@pytest.mark.parametrize("period", [ACADEMIC_YEAR, AWARD_TERM])
def test_awards_taken_back(spark, tmp_path, period):
    """A term that loses all its awards, and one that loses some; other partitions keep their files."""
    tables = hot_tables(spark)
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    store = laurel.CompleterStore(spark, str(tmp_path / "cells"))
    store.build(tables, calendar)
    first = files(store.path)
    when = tables.awards["Award_Date"]
    emptied = (when >= str(day_in(19990))) & (when < str(day_in(19991)))
    thinned = (when >= str(day_in(19982))) & (when < str(day_in(19983))) & (tables.awards["Student_Id"] % 3 == 0)
    gone = tables.awards.where(emptied | thinned)
    left = Domain.from_frames(spark, **{
        name: tables.awards.where(~(emptied | thinned)) if name == "awards" else tables[name] for name in laurel.SCHEMAS})
    counted = store.refresh(left, calendar, gone, calendar.current_term)
    again = files(store.path)
    assert counted and partition_terms({p for p in first if first[p] == again.get(p)}) == \
        partition_terms(first) - set(counted) != set()
    for strata in SPLITS.values():
        full = laurel.report_completers(
            {"all": laurel.awards_all(left, calendar, details=(D.STUDENT,))}, period, strata)
        report = store.report(calendar, period, strata)
        assert sorted(map(str, dicts(report.select(full.columns)))) == sorted(map(str, dicts(full))) != []
    # Nothing is left at last, and the store says so.
    none = Domain.from_frames(spark, **{
        name: tables.awards.limit(0) if name == "awards" else tables[name] for name in laurel.SCHEMAS})
    store.refresh(none, calendar, tables.awards, calendar.current_term)
    assert store.report(calendar, period).collect() == []


def test_a_refresh_reads_only_the_terms_it_counts(spark, tmp_path):
    from laurel.plans.refresh import award_cells

    hot_tables(spark).save(str(tmp_path))
    tables = Domain.from_parquet(spark, str(tmp_path))
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    text = award_cells(tables, calendar, [19981, 20003])._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in text.split("\n") if "FileScan parquet" in line and "/awards]" in line)
    assert "1998-02-05" in scan and "2000-08-25" in scan and "Or(" in scan


def test_runs_of_terms(spark):
    tables = domain(spark, terms=terms(19990, 20013))
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    assert calendar.runs([19993, 20000, 20002, 20013]) == [(19993, 20000), (20002, 20002), (20013, 20013)]
    assert calendar.runs([]) == []
