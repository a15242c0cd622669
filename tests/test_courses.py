from __future__ import annotations

import datetime as dt

import laurel
from laurel.operators import courses as C
from laurel.operators.selection import Strata
from small import day_in, dicts, domain, terms

TAKER = "College string, Major_Code string, Award_Type string, Gender string, Ethnicity string, Course string"
STUDENT = "College string, Major_Code string, Award_Type string, Gender string, Ethnicity string"


def frames(spark):
    takers = [("E", "1", "AA", g, "White", c) for g, c, n in [
        ("Male", "X", 3), ("Female", "X", 1), ("Male", "Y", 1), ("Female", None, 3), ("Male", "Z", 2)]
        for _ in range(n)]
    takers.append(("E", "2", "AA", "Female", "White", "X"))
    students = [("E", "1", "AA", g, "White") for g, n in [("Male", 4), ("Female", 3)] for _ in range(n)]
    return spark.createDataFrame(takers, TAKER), spark.createDataFrame(students, STUDENT)


def cells(df, *columns):
    return {tuple(r[c] for c in columns) for r in dicts(df)}


def test_unsplit_has_no_minimum_group(spark):
    takers, students = frames(spark)
    result = C.course_distribution(takers, students, cutoff=0.3)
    assert cells(result, "Course", "Count", "Group_Size") == {("X", 4, 7), (None, 3, 7)}
    assert cells(C.course_heatmap(result), "Category") == {("All Students",)}


def test_split_keeps_a_course_in_all_strata_if_one_passes(spark):
    takers, students = frames(spark)
    split = Strata.by_gender()
    result = C.course_distribution(takers, students, strata=split, cutoff=0.5)
    assert cells(result, "Gender", "Course", "Proportion") == {
        ("Male", "X", 0.75), ("Female", "X", 1 / 3), ("Female", None, 1.0)}
    small = C.course_distribution(takers, students, strata=split, cutoff=0.5, min_students=4)
    assert cells(small, "Gender", "Course") == {("Male", "X")}


def test_unknown_share_in_one_stratum_drops_the_course(spark):
    takers, _ = frames(spark)
    only_men = spark.createDataFrame([("E", "1", "AA", "Male", "White")] * 4, STUDENT)
    result = C.course_distribution(takers, only_men, strata=Strata.by_gender(), cutoff=0.2)
    assert cells(result, "Gender", "Course") == {("Male", "Y"), ("Male", "Z")}
    largest = C.max_course_share(C.course_shares(takers, only_men, Strata.by_gender()))
    assert ("1", "X", None) in cells(largest, "Major_Code", "Course", "Max_Proportion")


def tables(spark):
    def taken(student, number, term, grade="A"):
        return dict(Student_Id=student, College="E", Year_Semester=term, Section_Number=number, Grade=grade)

    names = {1: "MATH 1", 2: "ART 1", 3: "ART 2", 4: "MATH 105"}
    taken_rows = [taken(1, 1, 20001), taken(1, 1, 20003), taken(1, 2, 20003), taken(1, 4, 20003),
                  taken(2, 2, 20001), taken(2, 3, 20001), taken(2, 3, 19993), taken(2, 1, 20001, "E"),
                  taken(2, 77, 20003)]
    return domain(
        spark, terms=terms(19900, 20013), cohorts=[(1, 20000, "E"), (2, 20000, "E")],
        students=[(1, "M", "White", "English", 0), (2, "F", "Asian", "English", 0)],
        awards=[(1, "E", "000100", "AA", day_in(20003), 1), (1, "E", "000100", "AA", day_in(20003), 1),
                (2, "E", "000100", "AA", day_in(20003), 1), (2, "E", "000100", "AS", day_in(20003), 1)],
        enrollments=taken_rows,
        sections2=[dict(Section_Number=r["Section_Number"], College="E", Year_Semester=r["Year_Semester"],
                        Discipline="D", Course=names[r["Section_Number"]], Noncredit=0)
                   for r in taken_rows if r["Section_Number"] in names and r["Grade"] != "E"],
    )


def test_course_takers_are_distinct(spark):
    data = tables(spark)
    calendar = laurel.Calendar.load(data, dt.date(2001, 9, 1))
    rows = dicts(laurel.course_takers(data, calendar))
    arts = [r for r in rows if r["Award_Type"] == "Associate in Arts"]
    assert sorted(str(r["Course"]) for r in arts if r["Gender"] == "Male") == ["ART 1", "MATH 1", "MATH 105"]
    assert sorted(str(r["Course"]) for r in arts if r["Gender"] == "Female") == ["ART 1", "ART 2", "None"]
    assert sum(r["Award_Type"] == "Associate in Science" for r in rows) == 3


def test_top_courses_count_award_rows_and_break_ties_by_name(spark):
    data = tables(spark)
    calendar = laurel.Calendar.load(data, dt.date(2001, 9, 1))
    listed = laurel.top_program_courses(data, calendar, "000100", "AA", count_cutoff=2,
                                        special_courses=["MATH 105", "ART 1"])
    assert [(r["rank"], r["Course"]) for r in listed.orderBy("rank").collect()] == [
        (1, "MATH 1"), (2, "ART 2"), (3, "MATH 105"), (4, "ART 1")]
    twice = laurel.top_program_courses(data, calendar, "000100", "AA", count_cutoff=1, special_courses=["ZOO 1"])
    assert [r["Course"] for r in twice.orderBy("rank").collect()] == ["MATH 1", "ZOO 1"]
