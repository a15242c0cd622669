from __future__ import annotations

import datetime as dt

import laurel
from laurel.operators import survival as S
from small import day_in, dicts, domain, terms


def profile(student, term, college="E", **more):
    base = dict(Units_Attempted=6, Units_Completed=5, Online_Only=0, SGEC_Only=1, PSA_Only=0, Concurrent_Student=0,
                Major_Code="000200", Term_Age=20, Education_Goal="Transfer", Residency_Status="AB 540", Military=0,
                DSPS=0, EOPS=1, CalWorks=0, BOGG=1, Total_Award=400.0, District_Cumulative_GPA=3.0)
    return dict(base, Student_Id=student, College=college, Year_Semester=term, **more)


def tables(spark):
    def taken(term, number, grade="A", student=1):
        return dict(Student_Id=student, College="E", Year_Semester=term, Section_Number=number, Grade=grade)

    taken_rows = [taken(19950, 1), taken(19961, 1), taken(19961, 1), taken(19962, 2), taken(19963, 2, "F"),
                  taken(19970, 1), taken(19963, 1, student=9)]
    return domain(
        spark, terms=terms(19900, 20013),
        students=[(1, "F", "White", "Spanish", 1), (2, "M", "White", "English", 0)],
        cohorts=[(1, 19960, "E"), (2, 19961, "E"), (3, 19961, "W"), (4, 19900, "E")],
        awards=[(1, "E", "000100", "AA", day_in(19951), 1), (1, "E", "000100", "AA", day_in(19970), 1),
                (2, "E", "000100", "AS", day_in(19963), 1)],
        ethnicity_details=[(1, 1, 0)],
        student_profiles=[
            profile(1, 19952, PSA_Only=1), profile(1, 19960, Major_Code="000100"),
            profile(1, 19961), profile(1, 19963), profile(1, 19970, Total_Award=800.0), profile(1, 19971),
            profile(1, 20013), profile(1, 19962, college="W"), profile(2, 19970), profile(3, 19970),
            profile(4, 19970),
        ],
        enrollments=taken_rows,
        sections2=[dict(Section_Number=n, College="E", Year_Semester=t, Course=c, Noncredit=0)
                   for n, t, c in {(r["Section_Number"], r["Year_Semester"],
                                    "MATH 1" if r["Section_Number"] == 1 else "ART 2.5") for r in taken_rows}],
    )


def test_person_period(spark):
    data = tables(spark)
    calendar = laurel.Calendar.load(data, dt.date(2001, 9, 1))
    table = laurel.survival_person_period(data, calendar, "000100", "AA", ["MATH 1", "ART 2.5"])
    rows = sorted(dicts(table), key=lambda r: (r["Student_Id"], r["Year_Semester"]))
    mine = [r for r in rows if r["Student_Id"] == 1]
    assert [(r["Previous_Year_Semester"], r["Year_Semester"]) for r in mine] == [(0, 1), (1, 3), (3, 4)]
    assert [r["Earned_Award"] for r in mine] == [0, 0, 1]  # later terms with the award are out
    assert [r["Units_Completed"] for r in mine] == [5, 10, 15]
    assert [r["Total_Award"] for r in mine] == [100.0, 100.0, 400 / 3]
    assert [(r["MATH_1"], r["ART_2_5"]) for r in mine] == [(3, 0), (3, 1), (4, 1)]
    assert {(r["Former_PSA_Student"], r["Former_Concurrent_Student"], r["Declared_Major_at_Entry"],
             r["Term_Age"], r["GPA"], r["Any_Hispanic"], r["Female"], r["Spanish_Speaking"], r["Foster_Youth"],
             r["EOPS"] == r["BOGG"], r["SGEC_Only_Terms"] == r["EOPS"]) for r in mine} == {
        (1, 0, 1, 2, 1.0, 1, 1, 1, 1, True, True)}
    other = [r for r in rows if r["Student_Id"] != 1]
    assert [(r["Student_Id"], r["Year_Semester"], r["Previous_Year_Semester"], r["Earned_Award"],
             r["Declared_Major_at_Entry"], r["MATH_1"], r["Any_Asian"]) for r in other] == [
        (2, 3, 0, 0, None, 0, None)]


def test_first_award_row(spark):
    df = spark.createDataFrame([(1, t, f) for t, f in zip([1, 2, 3, 4], [0, 0, 1, 1])],
                               "Student_Id bigint, Year_Semester int, Earned_Award int")
    assert sorted(r["Year_Semester"] for r in S.first_award_row(df).collect()) == [1, 2, 3]


def test_award_term_is_the_last_one(spark):
    data = tables(spark)
    calendar = laurel.Calendar.load(data, dt.date(2001, 9, 1))
    assert dicts(S.student_award_term(data, calendar, "E", "000100", "AA")) == [
        {"Student_Id": 1, "Award_Year_Semester": 19970}]
