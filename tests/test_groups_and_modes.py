"""Two completer groups in one reading, split modes as grouping sets, counts of people."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest

import laurel
from checks.catalog import SPLITS, Session
from laurel.functions import levels as L
from laurel.operators import bitmaps as B
from laurel.operators import counting as N
from laurel.plans import datasets as D
from small import day_in, dicts, domain, terms

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("domain"))
    laurel.derive_domain(spark, folder=FOLDER).save(folder)
    return Session(spark, laurel.Domain.from_parquet(spark, folder))


def scans(df, table):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"FileScan parquet.*/{table}\]", plan))


@pytest.mark.parametrize("report", ["time", "sgec", "online", "completers"])
def test_two_groups_read_each_table_once(stored, report):
    plan = {
        "time": lambda: laurel.report_time_to_award(stored.groups(*D.DETAILS)),
        "sgec": lambda: laurel.report_sgec(stored.groups(D.UNITS), 60),
        "online": lambda: laurel.report_online(stored.groups(D.UNITS), 60),
        "completers": lambda: laurel.report_completers(stored.groups(D.STUDENT), strata=SPLITS["gender"]),
    }[report]()
    assert [scans(plan, t) for t in ("awards", "cohorts")] == [1, 1]
    assert scans(plan, "student_profiles") == (report != "completers")


def test_course_report_reads_completers_once(stored, spark):
    takers, students = laurel.course_taking(stored.domain, stored.calendar)
    plan = laurel.report_course_taking(takers, students)
    assert [scans(plan, t) for t in ("awards", "cohorts", "students", "sections2")] == [0, 0, 0, 1]
    assert plan.count() > 0


@pytest.mark.parametrize("name, build, table", [
    ("completers", lambda s: laurel.report_completers_modes(s.awards(D.STUDENT)), "awards"),
    ("change", lambda s: laurel.report_change_completers_modes(s.spans), "awards")])
def test_modes_are_one_reading(stored, name, build, table):
    plan = build(stored)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert scans(plan, table) == 1 and len(re.findall(r"\bExpand\b", text)) == 1


def test_modes_equal_the_reports_of_each_mode(stored):
    every = dicts(laurel.report_completers_modes(stored.awards(D.STUDENT)))
    for mode, strata in SPLITS.items():
        rows = dicts(laurel.report_completers(stored.completers(D.STUDENT), strata=strata, fill=False))
        own = {(r["Award_Type"], r["Academic_Year_Key"], r[strata.column] if mode else "All Students"): (r["Count"], r["Proportion"])
               for r in rows}
        assert own == {(r["Award_Type"], r["Period_Key"], r["Category"]): (r["Count"], r["Proportion"])
                       for r in every if r["Mode"] == (mode or "none") and r["Scale"] == "academic_year"}


def hot_tables(spark):
    """Student 1 has a third of all awards; some students entered twice or never."""
    source = random.Random(9)
    codes = [t for t in range(19960, 20013) if t % 10 < 4]
    people = [*range(1, 40), 10 ** 12, 10 ** 15]
    awards = [(1 if source.random() < 0.35 else source.choice(people), source.choice("EEW"), "000100",
               source.choice(["AA", "AS", "ZZ"]), day_in(source.choice(codes)), 19981999) for _ in range(900)]
    cohorts = [(p, source.choice(codes), source.choice("EW")) for p in people if p % 7]
    cohorts += [(3, 19963, "E"), (3, 19963, "E"), (4, 19970, "E"), (4, 19981, "W")]
    return domain(
        spark, terms=terms(19850, 20013), awards=awards, cohorts=cohorts,
        students=[(p, source.choice(["M", "F", None]), source.choice(["White", "Asian", "Other"]), "English", 0) for p in people],
        programs=[("E", "000100", "P", a, 19981999, None) for a in ("AA", "AS", "ZZ")],
        student_profiles=[dict(Student_Id=p, College="E", Year_Semester=t, Units_Attempted=4, Units_Completed=3,
                               SGEC_Units=t % 3, Online_Units=t % 2) for p in people for t in codes[::5]])


@pytest.mark.parametrize("details", [(), ("student",), ("cohort",), ("student", "cohort", "units")])
@pytest.mark.parametrize("colleges", [["E"], ["E", "W"]])
def test_groups_equal_the_two_data_sets(spark, details, colleges):
    tables = hot_tables(spark)
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    both = laurel.award_groups(tables, calendar, colleges=colleges, details=details)
    for name, build in ((L.ALL_COMPLETERS, laurel.awards_all), (L.SIX_YEAR_COHORT, laurel.awards_cohort)):
        rows = build(tables, calendar, colleges=colleges, details=details)
        own = both.where(both["Group"] == name).select(*rows.columns)
        assert sorted(map(str, own.collect())) == sorted(map(str, rows.collect())) != []


def test_students_are_numbered_without_gaps(spark):
    source = random.Random(4)
    ids = [source.randrange(-10 ** 17, 10 ** 18) for _ in range(5000)] + [7] * 3000 + [None]
    rows = spark.createDataFrame([(i,) for i in ids], "Student_Id long").repartition(9)
    found = {r["Student_Id"]: r["Number"] for r in dicts(B.number_students(rows))}
    known = sorted({i for i in ids if i is not None})
    assert found == {i: k + 1 for k, i in enumerate(known)}
    assert dicts(B.number_students(rows.limit(0))) == []


def test_bitmaps_merge_to_distinct_counts(spark):
    """More numbers than one bitmap holds, and a number with a third of all rows."""
    source = random.Random(6)
    rows = [(source.choice("abc"), source.choice([1, 32768, 32769, source.randrange(1, 200_000)])) for _ in range(20_000)]
    maps = B.bitmaps(spark.createDataFrame(rows, "g string, Number long").repartition(7), ["g"])
    assert {r["g"]: r["People"] for r in dicts(B.count_people(maps, ["g"]))} == {
        g: len({n for h, n in rows if h == g}) for g in "abc"}
    some = maps.where("g <> 'a'").groupBy("Bucket").agg(B.merged())
    assert dicts(B.count_people(some, []))[0]["People"] == len({n for h, n in rows if h != "a"})


def test_people_per_cohort_with_a_hot_student(spark):
    tables = hot_tables(spark)
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    spans = laurel.rolling_spans(tables, calendar, person=True)
    found = {(r["Mode"], r["Category"], r["Award_Type"], r["Completion_Cohort_Key"]): r["People"]
             for r in dicts(laurel.change_in_people(spans))}
    people = {}
    for r in dicts(spans):
        categories = [("none", "All Students"), ("gender", r["Gender"]), ("ethnicity", r["Ethnicity"]),
                      ("ethnicity_gender", r["Ethnicity"] and f"{r['Ethnicity']} {r['Gender']}")]
        for at in range(r["Start"], r["End"]):
            for mode, category in categories:
                if category is not None:
                    people.setdefault((mode, category, r["Award_Type"], at // 4 * 10 + at % 4), set()).add(r["Student_Id"])
    assert found == {k: len(v) for k, v in people.items()} and len(found) > 100


def test_people_with_a_hot_student(spark):
    tables = hot_tables(spark)
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    awards = laurel.awards_all(tables, calendar, details=(D.STUDENT, D.PERSON))
    found = dicts(laurel.distinct_completers(awards, laurel.number_students(tables.students)))
    rows = [r for r in dicts(awards) if r["Academic_Year_Key"] is not None]
    for r in found:
        chosen = [x for x in rows if r["Award_Type"] in (x["Award_Type"], "Any award")
                  and r["Academic_Year_Key"] in (x["Academic_Year_Key"], 0)]
        stratum = {"none": lambda x: "All Students", "gender": lambda x: x["Gender"], "ethnicity": lambda x: x["Ethnicity"],
                   "ethnicity_gender": lambda x: f"{x['Ethnicity']} {x['Gender']}"}[r["Mode"]]
        assert r["People"] == len({x["Student_Id"] for x in chosen if stratum(x) == r["Category"]}) > 0
    total = [r for r in found if (r["Mode"], r["Award_Type"], r["Academic_Year"]) == ("none", "Any award", "All years")]
    assert [r["People"] for r in total] == [len({x["Student_Id"] for x in rows})]
    assert N.distinct_values(awards, ["Student_Id"]).count() == total[0]["People"]
