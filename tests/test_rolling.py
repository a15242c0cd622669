from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from statistics import median

import laurel
from laurel.functions.terms import term_codes
from laurel.operators.rolling import (
    cohort_grid, count_by_cohort, explode_completion_cohorts, with_span, without_overlap,
)
from laurel.plans import reports
from small import day_in, dicts, domain, terms

FIRST, CURRENT, LENGTH = 19953, 20013, 6


def by_rule(cohort, award):
    return [c for c in term_codes(FIRST, CURRENT - 1)
            if cohort > c - LENGTH * 10 and cohort <= award < c]


def test_cohorts_of_an_award_follow_the_rule(spark):
    codes = term_codes(19880, 20023)
    pairs = [(c, a) for c in codes[::3] for a in codes[::2]] + [(19960, None), (None, 19960), (19965, 19971)]
    df = spark.createDataFrame(pairs, "Cohort int, Year_Semester int")
    rolled = explode_completion_cohorts(df, FIRST, CURRENT, LENGTH)
    found = {}
    for row in rolled.collect():
        found.setdefault((row["Cohort"], row["Year_Semester"]), []).append(row["Completion_Cohort"])
    for pair in pairs:
        if None in pair or pair[0] % 10 > 3:
            expected = [None]
        else:
            expected = by_rule(*pair) or [None]
        assert sorted(found[pair], key=str) == sorted(expected, key=str)


def test_bounds(spark):
    df = spark.createDataFrame([(19953, 19961)], "Cohort int, Year_Semester int")
    cohorts = [r["Completion_Cohort"] for r in explode_completion_cohorts(df, FIRST, CURRENT, LENGTH).collect()]
    assert min(cohorts) == 19962 and max(cohorts) == 20012
    assert all(c % 10 < 4 for c in cohorts)


def random_awards(seed, n):
    source = random.Random(seed)
    codes = term_codes(19880, 20023)
    rows = [(source.choice("ab"), source.randrange(6), source.choice(codes), source.choice(codes)) for _ in range(n)]
    rows += [("a", 1, 19970, 19981)] * n  # a third of all awards in one run
    return rows + [(None, 2, 19970, 19981), ("b", 3, None, 19981), ("b", 3, 19970, None), ("b", 3, 19965, 19971),
                   ("b", 3, 19970, 19976)]


SPANNED = "Kind string, Student int, Cohort int, Year_Semester int"


def test_sweep_equals_listed_cohorts(spark):
    rows = random_awards(1, 400)
    spans = with_span(spark.createDataFrame(rows, SPANNED), FIRST, CURRENT, LENGTH)
    found = {(r["Kind"], r["Completion_Cohort_Key"]): r["Count"] for r in dicts(count_by_cohort(spans, ["Kind"]))}
    expected = Counter((kind, c) for kind, _, cohort, award in rows if None not in (cohort, award)
                       and cohort % 10 < 4 and award % 10 < 4 for c in by_rule(cohort, award))
    assert found == expected and len(found) > 60
    doubled = spans.selectExpr("*", "2L as Two")
    assert {(r["Kind"], r["Completion_Cohort_Key"]): r["n"] // 2
            for r in dicts(count_by_cohort(doubled, ["Kind"], "n", "Two"))} == expected
    assert dicts(count_by_cohort(spans.limit(0), ["Kind"])) == []


def test_people_count_once_where_their_runs_overlap(spark):
    rows = random_awards(2, 300)
    spans = with_span(spark.createDataFrame(rows, SPANNED), FIRST, CURRENT, LENGTH)
    parts = without_overlap(spans, ["Kind", "Student"]).where("Fresh < End").drop("Start")
    counted = count_by_cohort(parts.withColumnRenamed("Fresh", "Start"), ["Kind"], "People")
    found = {(r["Kind"], r["Completion_Cohort_Key"]): r["People"] for r in dicts(counted)}
    people = {(kind, c, student) for kind, student, cohort, award in rows if None not in (cohort, award)
              and cohort % 10 < 4 and award % 10 < 4 for c in by_rule(cohort, award)}
    assert found == Counter((kind, c) for kind, c, _ in people)


def test_sliding_histogram_gives_medians(spark):
    source = random.Random(3)
    rows = [(source.choice(["AA", "AS"]), "Male", "White", source.randrange(0, 24), a, a + source.randrange(1, 12))
            for a in (source.randrange(8000, 8010) for _ in range(300))]
    spans = spark.createDataFrame(
        rows, "Award_Type string, Gender string, Ethnicity string, Terms_to_Complete int, Start int, End int")
    times = {}
    for kind, _, _, years, start, end in rows:
        for at in range(start, end):
            code = at // 4 * 10 + at % 4
            times.setdefault((kind, code), []).append(years / 4)
    found = dicts(reports.report_change_time(spans, seasons=["Fall", "Spring"]))
    chosen = {k: v for k, v in times.items() if k[1] % 10 in (1, 3)}
    assert {(r["Award_Type"], r["Completion_Cohort_Key"]): (r["Group_Size"], r["Median_Years"]) for r in found} == {
        k: (len(v), median(v)) for k, v in chosen.items()}
    assert {r["Median_Years_Overall"] for r in found} == {median(x for v in chosen.values() for x in v)}
    boxes = dicts(reports.time_boxplot(spans))
    assert {(r["Award_Type"], r["Completion_Cohort_Key"]): r["Median_Years"] for r in boxes} == {
        k: median(v) for k, v in times.items()}


def test_grid_equals_filtered_triples(spark):
    grid = {tuple(r) for r in cohort_grid(spark, 19993, 20013, 2).collect()}
    codes = term_codes(19800, 20012)
    assert grid == {(c, a, cc) for c in codes for cc in codes for a in codes
                    if c > cc - 20 and cc >= 19993 and c <= a < cc}


def test_grid_size_of_a_known_term(spark):
    assert cohort_grid(spark, 20173 - 60, 20173, 6).count() == 6624


def efficiency_tables(spark):
    section = dict(Discipline="D", Course="D 1", Noncredit=0, Enrollment=10, FTES=5.0,
                   Standard_Hours=54.0, Teaching_Load=270.0)

    def taken(student, number, term, grade="A", college="E"):
        return dict(Student_Id=student, College=college, Year_Semester=term, Section_Number=number, Grade=grade)

    return domain(
        spark,
        terms=terms(19900, 20013),
        students=[(i, "M", "White", "English", 0) for i in (1, 2, 3)],
        cohorts=[(1, 20000, "E"), (2, 20000, "E"), (3, 20000, "E")],
        programs=[("E", "000100", "P", "AA", 19981999, None)],
        awards=[
            (1, "E", "000100", "AA", day_in(20003), 19981999),
            (1, "E", "000100", "AA", day_in(20003) + dt.timedelta(days=1), 19981999),
            (2, "E", "000100", "AA", day_in(20003), 19981999),
            (3, "E", "000100", "AA", day_in(20003), 19981999),
        ],
        enrollments=[
            taken(1, 1, 20001), taken(1, 2, 20003), taken(1, 1, 20010), taken(1, 1, 19993),
            taken(1, 3, 20001, "E"), taken(1, 4, 20001), taken(1, 5, 20001, college="W"),
            taken(2, 99, 20001),
        ],
        sections2=[
            dict(section, Section_Number=n, College=c, Year_Semester=t, Enrollment=e)
            for n, c, t, e in [(1, "E", 20001, 10), (2, "E", 20003, 20), (1, "E", 20010, 1), (1, "E", 19993, 1),
                               (3, "E", 20001, 1), (4, "E", 20001, 0), (5, "W", 20001, 1)]
        ],
    )


def test_efficiency_path(spark):
    """Only own-college sections between entry and award count, once per award."""
    tables = efficiency_tables(spark)
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    rows = dicts(laurel.efficiency(tables, calendar))
    assert [r["Completion_Cohort_Key"] for r in sorted(rows, key=lambda r: r["Completion_Cohort_Key"])] == [
        20010, 20011, 20012]
    for row in rows:
        assert row["Completers"] == 2  # student 2 has no section, student 3 no enrollment
        assert abs(row["FTES"] - 2 * (5 / 10 + 5 / 20)) < 1e-12
        assert abs(row["FTEF"] - 2 * (0.2 / 10 + 0.2 / 20)) < 1e-12
        assert abs(row["Efficiency"] - 25) < 1e-9


def test_rolling_drops_incomplete_rows_before_recoding(spark):
    tables = domain(
        spark, terms=terms(19900, 20013),
        students=[(1, "M", "Other", "English", 0), (2, None, "White", "English", 0)],
        cohorts=[(1, 20003, "E"), (2, 20003, "E")],
        programs=[("E", "000100", "P", "AA", 19981999, None)],
        awards=[(s, "E", "000100", "AA", day_in(20011), 19981999) for s in (1, 2)])
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    rows = dicts(laurel.rolling_cohorts(tables, calendar))
    assert [(r["Completion_Cohort"], r["Ethnicity"], r["Term"], r["Terms_to_Complete"]) for r in rows] == [
        ("Summer 2001", None, "Summer", 2)]


def test_a_student_counts_once_per_program_with_two_entries(spark):
    """Two entry terms give two paths; the effort of both counts, the student once."""
    tables = efficiency_tables(spark)
    twice = domain(
        spark, terms=terms(19900, 20013), students=[(1, "M", "White", "English", 0)],
        cohorts=[(1, 20000, "E"), (1, 19990, "E")], programs=[("E", "000100", "P", "AA", 19981999, None)],
        awards=[(1, "E", "000100", "AA", day_in(20003), 19981999)],
        enrollments=tables.enrollments.where("Student_Id = 1").collect(),
        sections2=tables.sections2.collect())
    rows = dicts(laurel.efficiency(twice, laurel.Calendar.load(twice, dt.date(2001, 9, 1))))
    assert len(rows) == 3 and {r["Completers"] for r in rows} == {1}
