"""Which courses completers take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.functions.levels import ALL_STUDENTS, SPECIAL_COURSES
from laurel.functions.recode import zero_if_nan
from laurel.operators.awards import join_entry_cohort
from laurel.operators.counting import count_cells
from laurel.operators.modes import STRATA, over_modes
from laurel.operators.paths import joined_enrollments, merged_by_key
from laurel.operators.selection import (
    Strata, filter_award_types, filter_excluded_courses, filter_min_group, filter_program,
)
from laurel.sources.domain import Domain

PROGRAM = ["College", "Major_Code", "Award_Type"]

__all__ = [
    "SPECIAL_COURSES", "append_courses", "course_counts", "course_distribution", "course_shares",
    "distinct_course_takers", "group_sizes", "max_course_share", "program_course_counts",
    "top_courses",
]


def completed_programs(domain: Domain, cohorts: DataFrame, colleges: Sequence[str],
                       majors: Sequence[str] | None) -> DataFrame:
    """Programs completed by cohort students at their college of entry.

    Rows counts the award rows, Weight the days with an award. Cohorts are merged: they have a row
    per student, and from their compressed files Spark takes millions for small.
    """
    days = F.collect_set(F.struct("Award_Date"))  # a student's days, no more than the calendar has
    programs = filter_program(domain.awards, colleges, majors).groupBy("Student_Id", *PROGRAM).agg(
        F.count(F.lit(1)).alias("Rows"), F.size(days).cast("bigint").alias("Weight"))
    return join_entry_cohort(programs, merged_by_key(cohorts), colleges)


def distinct_course_takers(domain: Domain, cohorts: DataFrame, current: int,
                           colleges: Sequence[str], majors: Sequence[str] | None,
                           first: int | None = None) -> DataFrame:
    """Distinct (student, discipline, course, program) of courses taken since entry.

    Enrollments are reduced to the last term per student and course before students are
    matched; a course counts if that term is not before entry. So the join makes exactly
    the result rows, also for a student with very many awards and enrollments. Of several
    entries at a college the first one counts. `first` is a term no cohort precedes.
    """
    programs = completed_programs(domain, cohorts, colleges, majors)
    return courses_since_entry(domain, programs, current, first).select(
        "Student_Id", "Discipline", "Course", *PROGRAM)


def courses_since_entry(domain: Domain, programs: DataFrame, current: int, first: int | None = None,
                        kept: Sequence[str] = ()) -> DataFrame:
    """Distinct courses of the students in `programs` (see above), with their `kept` columns."""
    programs = programs.groupBy("Student_Id", *PROGRAM, *kept).agg(F.min("Cohort").alias("Cohort"))
    taken = joined_enrollments(domain, domain.sections2, programs, current, first, "Discipline", "Course")
    last_taken = taken.groupBy(
        "Student_Id", "Discipline", "Course").agg(F.max("Year_Semester").alias("Last_Term"))
    taken = last_taken.join(programs, "Student_Id", "inner")
    return taken.where(F.col("Last_Term") >= F.col("Cohort")).select(
        "Student_Id", "Discipline", "Course", *PROGRAM, *kept
    )


def program_course_counts(domain: Domain, cohorts: DataFrame, current: int, college: str,
                          major: str, award_type: str, first: int | None = None) -> DataFrame:
    """Course counts over (award, enrollment) pairs of one program, without pairing rows.

    An enrollment counts once for every award row of its student, which is a weight on
    the student's enrollments per course and term.
    """
    programs = completed_programs(domain, cohorts, [college], [major]).where(
        F.col("Award_Type") == award_type
    )
    people = programs.select("Student_Id", "Cohort", "Rows")
    taken = joined_enrollments(domain, domain.sections2, people, current, first, "Course")
    per_term = count_cells(taken, ["Student_Id", "Course", "Year_Semester"], "Taken")
    path = per_term.join(people, "Student_Id", "inner").where(
        F.col("Year_Semester") >= F.col("Cohort")
    )
    return path.groupBy("Course").agg(F.sum(F.col("Rows") * F.col("Taken")).alias("Count"))


def top_courses(counts: DataFrame, n: int, excluded: Sequence[str]) -> DataFrame:
    """The n largest counts, ties by course name, ranked from 1."""
    order = [F.col("Count").desc(), F.col("Course")]
    top = filter_excluded_courses(counts, excluded).orderBy(*order).limit(n)
    ranks = F.row_number().over(W.orderBy(*order))  # at most n rows are left
    return top.select(ranks.alias("rank"), "Course")


def append_courses(courses: DataFrame, extra: Sequence[str], offset: int) -> DataFrame:
    """Put a fixed list after a ranked one; courses in both stay twice."""
    listed = courses.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(c) for c in extra])).alias("pos", "Course")
    )
    return courses.unionByName(listed.select((F.col("pos") + offset + 1).alias("rank"), "Course"))


def course_counts(takers: DataFrame, strata: Strata) -> DataFrame:
    return count_cells(strata.apply(takers), [*PROGRAM, *strata.columns, "Course"])


def group_sizes(students: DataFrame, strata: Strata) -> DataFrame:
    """Award rows per group; a row with a Weight stands for so many."""
    if "Weight" in students.columns:
        return strata.apply(students).groupBy(*PROGRAM, *strata.columns).agg(F.sum("Weight").alias("Group_Size"))
    return count_cells(strata.apply(students), [*PROGRAM, *strata.columns], "Group_Size")


def course_shares(takers: DataFrame, students: DataFrame, strata: Strata) -> DataFrame:
    """Takers of each course as a share of the award rows of their group."""
    keys = [*PROGRAM, *strata.columns]
    return with_group_share(course_counts(takers, strata), group_sizes(students, strata), keys)


def with_group_share(counts: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach Group_Size and the share of Count in it."""
    counted = counts.join(sizes, list(keys), "left")
    share = F.col("Count") / F.col("Group_Size")
    return counted.withColumn(
        "Proportion", F.when(share.isNotNull(), zero_if_nan(share))
    )


def max_course_share(shares: DataFrame) -> DataFrame:
    """Largest share per course over its strata; unknown as soon as one share is."""
    share = F.col("Proportion")
    complete = F.count(F.lit(1)) == F.count(share)
    return shares.groupBy(*PROGRAM, "Course").agg(
        F.when(complete, F.max(share)).alias("Max_Proportion")
    )


def shortlist_courses(shares: DataFrame, cutoff: float, within: Sequence[str] = ()) -> DataFrame:
    """Rows of the courses whose largest share passes the cutoff in some stratum.

    A window over the strata of a course (a short list) instead of a join back, which
    also keeps a missing course as a group of its own.
    """
    course = W.partitionBy(*within, *PROGRAM, "Course")
    share = F.col("Proportion")
    complete = F.count(F.lit(1)).over(course) == F.count(share).over(course)
    largest = F.when(complete, F.max(share).over(course))
    return shares.withColumn("_largest", largest).where(F.col("_largest") > cutoff).drop("_largest")


def course_distribution(takers: DataFrame, students: DataFrame,
                        award_types: Sequence[str] | None = None, strata: Strata = Strata(),
                        cutoff: float = 0.25, min_students: int = 3) -> DataFrame:
    """Course shares per program and stratum, for courses above the cutoff.

    Small groups are left out only when the report is split.
    """
    shares = course_shares(filter_award_types(takers, award_types), students, strata)
    listed = shortlist_courses(shares, cutoff)
    return listed if strata.column is None else filter_min_group(listed, min_students)


def distribution_modes(takers: DataFrame, students: DataFrame, award_types: Sequence[str] | None = None,
                       cutoff: float = 0.25, min_students: int = 3) -> DataFrame:
    """`course_distribution` of all split modes, told apart by Mode; Category is the stratum.

    Takers and completers are counted once by gender and ethnicity; the modes are grouping sets
    over these cells.
    """
    cells = count_cells(filter_award_types(takers, award_types), [*PROGRAM, *STRATA, "Course"])
    counts = over_modes(cells, [*PROGRAM, "Course"], [F.sum("Count").alias("Count")])
    people = students.groupBy(*PROGRAM, *STRATA).agg(F.sum("Weight").alias("Group_Size"))
    sizes = over_modes(people, PROGRAM, [F.sum("Group_Size").alias("Group_Size")])
    shares = with_group_share(counts, sizes, ["Mode", "Category", *PROGRAM])
    listed = shortlist_courses(shares, cutoff, ["Mode"])
    return listed.where((F.col("Mode") == "none") | (F.col("Group_Size") >= min_students))


def course_heatmap(distribution: DataFrame, strata: Strata = Strata()) -> DataFrame:
    """(Category, Course, Proportion) cells of a program."""
    category = F.lit(ALL_STUDENTS) if strata.column is None else F.col(strata.column)
    return distribution.select(*PROGRAM, category.alias("Category"), "Course", "Proportion")
