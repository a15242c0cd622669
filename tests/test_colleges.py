"""Several colleges at once, and a selection of majors, against the widened SQL."""

from __future__ import annotations

import datetime as dt

import pytest

import laurel
from checks import sql as Q
from checks.catalog import session_for
from checks.compare import connect
from small import day_in, dicts, domain, terms

FOLDER = "/root/testdata/sf0.01"  # the smaller one has no such student
COLLEGES, MAJORS = ["E", "W"], ["000100", "000300"]


@pytest.mark.parametrize("name, build", [
    ("awards_all", laurel.awards_all), ("awards_cohort", laurel.awards_cohort),
    ("rolling", laurel.rolling_cohorts), ("efficiency", laurel.efficiency),
    ("takers", laurel.course_takers),
])
def test_two_colleges_two_majors(spark, name, build):
    session = session_for(spark, FOLDER)
    result = build(session.domain, session.calendar, majors=MAJORS, colleges=COLLEGES)
    columns = result.columns
    sql = Q.compose(f"select {', '.join(columns)} from {name} where Major_Code in {Q.texts(MAJORS)}")
    expected = connect(FOLDER).execute(sql.replace("in ('E')", "in ('E', 'W')")).fetchall()

    def tidy(rows):
        return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)

    ours = tidy(tuple(r[c] for c in columns) for r in dicts(result))
    assert {r[columns.index("College")] for r in ours} == set(COLLEGES)
    assert ours == tidy(expected)


def test_paths_of_a_student_who_entered_two_colleges(spark):
    """Each award carries the effort of its own college's path."""
    def section(number, college, term, ftes):
        return dict(Section_Number=number, College=college, Year_Semester=term, Discipline="D", Course="D 1",
                    Noncredit=0, Enrollment=10, FTES=ftes, Standard_Hours=54.0, Teaching_Load=270.0)

    def taken(number, college, term):
        return dict(Student_Id=1, College=college, Year_Semester=term, Section_Number=number, Grade="A")

    tables = domain(
        spark, terms=terms(19900, 20013), students=[(s, "M", "White", "English", 0) for s in (1, 2)],
        cohorts=[(1, 19990, "E"), (1, 20000, "W"), (2, 19990, "E"), (2, 19991, "E")],
        programs=[(c, "000100", "P", "AA", 19981999, None) for c in "EW"],
        awards=[(1, c, "000100", "AA", day_in(20003), 19981999) for c in "EW"]
        + [(2, "E", "000200", "AA", day_in(20003), 19981999)],
        enrollments=[taken(1, "E", 19991), taken(2, "E", 20001), taken(3, "W", 20001), taken(4, "W", 19991),
                     {**taken(1, "E", 19991), "Student_Id": 2}],
        sections2=[section(1, "E", 19991, 100.0), section(2, "E", 20001, 1.0), section(3, "W", 20001, 10.0),
                   section(4, "W", 19991, 500.0)])
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    both = {c: set() for c in "EW"}
    for row in dicts(laurel.efficiency(tables, calendar, ["000100"], colleges=["E", "W"])):
        both[row["College"]].add(round(row["FTES"], 9))
    assert both == {"E": {10.1}, "W": {1.0}}
    takers = dicts(laurel.course_takers(tables, calendar, ["000200"]))
    assert len(takers) == 1  # two entries at one college are one taker
