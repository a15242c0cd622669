"""Parts of the person-period table: one row per student and term after entry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.functions import terms as T
from laurel.functions.levels import PASSING_GRADES
from laurel.functions.recode import flag, safe_name, zero_if_missing
from laurel.operators.paths import merged_by_key, of_students
from laurel.operators.selection import filter_program
from laurel.sources.calendar import Calendar
from laurel.sources.domain import Domain

# Running totals of the table: output -> source column.
RUNNING_TOTALS = {
    "EOPS": "EOPS",
    "CalWorks": "CalWorks",
    "BOGG": "BOGG",
    "Units_Completed": "Units_Completed",
    "Online_Only_Terms": "Online_Only",
    "SGEC_Only_Terms": "SGEC_Only",
}


def by_student_term() -> W:
    """Profiles have one row per student, college and term, so a partition is one
    student's terms at one college; the default frame runs up to the current term."""
    return W.partitionBy("Student_Id").orderBy("Year_Semester")


def student_award_term(domain: Domain, calendar: Calendar, college: str, major: str,
                       award_type: str) -> DataFrame:
    """Term of the last award in the program per student."""
    awards = filter_program(domain.awards, [college], [major]).where(
        F.col("Award_Type") == award_type
    )
    last = awards.groupBy("Student_Id").agg(F.max("Award_Date").alias("Award_Date"))
    # As-of terms never fall when dates rise, so the last date has the largest term.
    return calendar.with_term_as_of(last, "Award_Date", "Award_Year_Semester").drop("Award_Date")


def cohort_profiles(cohorts: DataFrame, profiles: DataFrame, college: str) -> DataFrame:
    """Profile rows of a college's cohort students at that college.

    The college is fixed, so the join needs only the student as key and later steps,
    all by student, can keep its partitioning.
    """
    own = profiles.where(F.col("College") == college).drop("College")
    entered = cohorts.where(F.col("Cohort_College") == college).drop("Cohort_College")
    return entered.join(own, "Student_Id", "inner")


def prior_history(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("Year_Semester") < F.col("Cohort"))


def prior_flags(rows: DataFrame) -> DataFrame:
    return prior_history(rows).groupBy("Student_Id").agg(
        F.max("PSA_Only").alias("Former_PSA_Student"),
        F.max("Concurrent_Student").alias("Former_Concurrent_Student"),
    )


def entry_term(rows: DataFrame, major: str) -> DataFrame:
    """Whether the program's major was declared in the term of entry."""
    return rows.where(F.col("Year_Semester") == F.col("Cohort")).select(
        "Student_Id", flag(F.col("Major_Code") == major).alias("Declared_Major_at_Entry")
    )


def entry_columns(major: str) -> list[Column]:
    """What `prior_flags` and `entry_term` give, beside every row of the student."""
    term, cohort = F.col("Year_Semester"), F.col("Cohort")
    student = W.partitionBy("Student_Id")

    def highest(condition: Column, value: Column) -> Column:
        return F.max(F.when(condition, value)).over(student)

    before = {
        "Former_PSA_Student": F.col("PSA_Only"),
        "Former_Concurrent_Student": F.col("Concurrent_Student"),
    }
    declared = flag(F.col("Major_Code") == major)
    return [
        *[zero_if_missing(highest(term < cohort, v)).alias(n) for n, v in before.items()],
        highest(term == cohort, declared).alias("Declared_Major_at_Entry"),
    ]


def after_entry() -> Column:
    return F.col("Year_Semester") > F.col("Cohort")


def spine(rows: DataFrame, current: int) -> DataFrame:
    """Terms after entry and before the current one."""
    return rows.where(after_entry() & (F.col("Year_Semester") < current))


def join_award_reached(rows: DataFrame, award_terms: DataFrame) -> DataFrame:
    """Mark terms at or after the award."""
    reached = F.col("Year_Semester") >= F.col("Award_Year_Semester")
    return rows.join(merged_by_key(award_terms), "Student_Id", "left").withColumn("Earned_Award", flag(reached))


def _masked(value: Column, rows: Column | None) -> Column:
    return value if rows is None else F.when(rows, value)


def previous_term(rows: Column | None = None) -> Column:
    """Latest earlier term of the student; the entry term for the first row.

    `rows` tells table rows from others in the same partition (here and below).
    """
    earlier = by_student_term().rangeBetween(W.unboundedPreceding, -1)
    term = _masked(F.col("Year_Semester"), rows)
    return F.coalesce(F.max(term).over(earlier), F.col("Cohort"))


def running_aid_terms(rows: Column | None = None) -> list[Column]:
    return [F.sum(_masked(F.col(source), rows)).over(by_student_term()).alias(name)
            for name, source in RUNNING_TOTALS.items()]


def running_average_award(rows: Column | None = None) -> Column:
    return F.avg(_masked(F.col("Total_Award") / 4, rows)).over(by_student_term())


def first_award_row(rows: DataFrame) -> DataFrame:
    """Keep rows before the award and the first one that has it."""
    order = W.partitionBy("Student_Id", "Earned_Award").orderBy("Year_Semester")
    ranked = rows.withColumn("_rank", F.row_number().over(order))
    return ranked.where((F.col("Earned_Award") == 0) | (F.col("_rank") == 1)).drop("_rank")


def passed_courses(domain: Domain, courses: Sequence[str], current: int,
                   people: DataFrame | None = None) -> DataFrame:
    """Passing enrollments of the listed courses before the current term, of `people` if given."""
    passed = domain.enrollments.where(
        F.col("Grade").isin(PASSING_GRADES) & (F.col("Year_Semester") < current)
    )
    passed = passed if people is None else of_students(passed, people)
    keys = ["Section_Number", "College", "Year_Semester"]
    listed = domain.sections2.where(F.col("Course").isin(list(courses))).select(*keys, "Course")
    return passed.join(listed, keys, "inner").select("Student_Id", "Year_Semester", "Course", "Grade")


def course_pivot_counts(passed: DataFrame, students: DataFrame, courses: Sequence[str]) -> DataFrame:
    """Passes per student and term, one column per listed course.

    Counted before the students are selected: the counting combines map-side, so a
    student with very many enrollments reaches that join as one row per term.
    """
    # A count per listed course, where `pivot` would shuffle by course once more.
    counts = passed.groupBy("Student_Id", "Year_Semester").agg(*[
        F.count(F.when(F.col("Course") == c, F.col("Grade"))).alias(safe_name(c)) for c in courses
    ])
    return counts.join(merged_by_key(students.select("Student_Id")), "Student_Id", "left_semi")


def stack_course_events(rows: DataFrame, pivoted: DataFrame, courses: Sequence[str]) -> DataFrame:
    """Put the pass counts below the table rows, marked by `_table_row`.

    Windows in term order then see both. Each side has one row per student and term, so
    this costs one short window per student, where joining every term with all earlier
    passes would grow with their product.
    """
    names = [safe_name(c) for c in courses]
    zeros = {n: F.lit(0).cast("bigint") for n in names}
    events = pivoted.withColumn("_table_row", F.lit(False))
    return rows.withColumns(zeros).withColumn("_table_row", F.lit(True)).unionByName(
        events, allowMissingColumns=True
    )


def cumulative_courses(courses: Sequence[str], first_term: int | None = None) -> list[Column]:
    """Passes of each course up to the row's term, over stacked rows.

    Rows of terms before `first_term`, if one is given, have zero passes.
    """
    term = F.col("Year_Semester")
    counted = T.is_regular_term(term)
    if first_term is not None:
        counted = counted & (term >= first_term)
    return [
        F.when(counted, F.sum(name).over(by_student_term())).otherwise(0).alias(name)
        for name in map(safe_name, courses)
    ]
