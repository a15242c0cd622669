from __future__ import annotations

import datetime as dt

import pytest

import laurel
from laurel.functions import levels as L
from small import day_in, dicts, domain, terms

AS_OF = dt.date(2001, 9, 1)


def award(student, term, college="E", major="000100", kind="AA", days=0):
    return dict(Student_Id=student, College=college, Major_Code=major, Award_Type=kind,
                Award_Date=day_in(term) + dt.timedelta(days=days), Catalog_Year=19981999)


def profile(student, term, attempted, sgec=0, online=0, college="E", **more):
    return dict(Student_Id=student, College=college, Year_Semester=term, Units_Attempted=attempted,
                Units_Completed=attempted, SGEC_Units=sgec, Online_Units=online, **more)


@pytest.fixture(scope="module")
def tables(spark):
    return domain(
        spark,
        terms=terms(19850, 20013),
        students=[(1, "M", "White", "English", 0), (2, "X", "Other", "English", 0),
                  (3, None, None, "English", 0), (4, "F", "Asian", "English", 0)],
        cohorts=[(1, 19960, "E"), (2, 19990, "W"), (4, 19993, "E")],
        awards=[
            award(1, 19981), award(1, 19981), award(1, 19981, kind="CS"),
            award(1, 19950), award(2, 19993), award(3, 20001), award(4, 19983),
            award(4, 20011, college="W"), award(4, 19840),
        ],
        student_profiles=[
            profile(1, 19963, 10, sgec=5), profile(1, 19971, 10, sgec=1, online=10),
            profile(1, 19983, 10, sgec=10), profile(1, 19971, 99, sgec=99, college="W"),
            profile(4, 19982, 0),
        ],
    )


@pytest.fixture(scope="module")
def calendar(tables):
    return laurel.Calendar.load(tables, AS_OF)


def test_awards_all(tables, calendar):
    rows = dicts(laurel.awards_all(tables, calendar))
    assert len(rows) == 5  # same day twice is one award; too early and other college are out
    first = next(r for r in rows if r["Award_Type"] == "Associate in Arts" and r["Cohort"] == 19960)
    assert first["Year_Semester"] == "Spring 1998" and first["Academic_Year"] == "1997-98"
    assert first["SGEC_Units"] == 6 / 20 and first["Online_Units"] == 0.5
    assert first["Terms_to_Complete"] == 9 and first["Gender"] == "Male"
    other = next(r for r in rows if r["Cohort"] == 19990)
    assert (other["Gender"], other["Ethnicity"], other["SGEC_Units"]) == ("Female", None, None)
    zero_units = next(r for r in rows if r["Cohort"] == 19993)
    assert zero_units["SGEC_Units"] is None and zero_units["Terms_to_Complete"] == -4


def test_awards_cohort(tables, calendar):
    rows = dicts(laurel.awards_cohort(tables, calendar))
    assert len(rows) == 5  # students 1 and 4 at their own college, whatever the award term
    early = [r for r in rows if r["Year_Semester"] is None]
    assert sorted(r["Terms_to_Complete"] is None for r in early) == [False, True]
    assert all(r["Academic_Year"] is None for r in early)


def test_several_colleges(tables, calendar):
    rows = dicts(laurel.awards_all(tables, calendar, colleges=["E", "W"]))
    assert sorted(r["College"] for r in rows) == ["E"] * 5 + ["W"]


def test_left_out_details_keep_the_rows(tables, calendar):
    full = laurel.awards_all(tables, calendar)
    bare = laurel.awards_all(tables, calendar, details=())
    assert sorted(map(str, bare.collect())) == sorted(map(str, full.select(*bare.columns).collect()))


def test_time_reports_name_what_they_need(tables, calendar):
    bare = laurel.awards_all(tables, calendar, details=("student", "cohort"))
    for build in (lambda: laurel.report_time_to_award({L.ALL_COMPLETERS: bare}),
                  lambda: laurel.time_histogram(bare), lambda: laurel.time_density(bare)):
        with pytest.raises(ValueError, match="SGEC_Units, Online_Units"):
            build()


def test_zero_units_leave_the_status_report(tables, calendar):
    report = laurel.report_sgec({L.ALL_COMPLETERS: laurel.awards_all(tables, calendar)}, 30, fill=False)
    assert {(r["Award_Type"], r["SGEC_Status"], r["Count"]) for r in dicts(report)} == {
        ("Associate in Arts", "SGEC student", 1), ("Skills Certificate", "SGEC student", 1)}


def test_ended_program_is_not_active(spark, tables):
    from laurel.operators.awards import active_programs

    programs = spark.createDataFrame(
        [("E", "000100", "Old", "AA", 19971998, None), ("E", "000100", "Old", "AA", 19961997, 19983),
         ("E", "000200", "New", "AA", 19971998, None)], laurel.SCHEMAS["programs"])
    assert [r["Major_Code"] for r in active_programs(programs, ["E"]).collect()] == ["000200"]


def test_program_names_take_the_latest_running_row(spark):
    tables = domain(spark, terms=terms(19990, 20013), programs=[
        ("E", "100", "Older", "AA", 19971998, None), ("E", "100", "Newer", "AA", 19991900 + 100, None),
        ("E", "100", "Ended", "AA", 20002001, 20003), ("E", "200", "Ancient", "AA", 19801981, None),
        ("W", "300", "Elsewhere", "AA", 19992000, None)])
    calendar = laurel.Calendar.load(tables, AS_OF)
    assert dicts(laurel.active_program_names(tables, calendar)) == [
        {"Major_Code": "000100", "Major": "Newer"}]
    assert dicts(laurel.program_codes(tables, calendar, ["Newer", "Ended"])) == [{"Major_Code": "000100"}]


def test_empty_result_keeps_its_schema(tables, calendar):
    nobody = laurel.awards_all(tables, calendar, majors=["999999"])
    report = laurel.report_completers({L.ALL_COMPLETERS: nobody}, strata=laurel.Strata.by_gender())
    assert report.collect() == []
    assert set(report.columns) == {"Award_Type", "Gender", "Academic_Year_Key", "Academic_Year",
                                   "Count", "Proportion", "Proportion_Label"}


def test_share_of_each_group_and_running_count(tables, calendar):
    groups = {L.ALL_COMPLETERS: laurel.awards_all(tables, calendar),
              L.SIX_YEAR_COHORT: laurel.awards_cohort(tables, calendar)}
    totals = {}
    for row in dicts(laurel.report_completers(groups, strata=laurel.Strata.by_gender(), fill=False)):
        key = row["Group"], row["Award_Type"], row["Academic_Year_Key"]
        totals[key] = totals.get(key, 0) + row["Proportion"]
    assert totals and all(abs(t - 1) < 1e-12 for t in totals.values())

    counts = dicts(laurel.completers(groups[L.ALL_COMPLETERS], laurel.AWARD_TERM, cumulative=True))
    arts = sorted((r["Year_Semester_Key"], r["Count"]) for r in counts
                  if r["Award_Type"] == "Associate in Arts")
    assert arts == [(19981, 1), (19983, 2), (19993, 3), (20001, 4)]


def test_reports_written_and_read_back(spark, tables, calendar, tmp_path):
    report = laurel.report_completers({L.ALL_COMPLETERS: laurel.awards_all(tables, calendar)})
    for fmt in ("parquet", "csv"):
        laurel.write_report(report, str(tmp_path / fmt), fmt)
    back = spark.read.parquet(str(tmp_path / "parquet"))
    assert back.columns == ["Award Type", "Count", "Proportion", "Proportion Label", "Academic Year"]
    assert back.count() == report.count()
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == back.columns


def test_stored_domain(spark, tables, calendar, tmp_path):
    expected = sorted(map(str, laurel.awards_all(tables, calendar).collect()))
    tables.save(str(tmp_path / "store"))
    stored = laurel.Domain.from_parquet(spark, str(tmp_path / "store"))
    assert sorted(map(str, laurel.awards_all(stored, calendar).collect())) == expected
    spark.sql("create database if not exists kept")
    tables.save_tables("kept", buckets=4)
    bucketed = laurel.Domain.from_tables(spark, "kept")
    assert sorted(map(str, laurel.awards_all(bucketed, calendar).collect())) == expected
