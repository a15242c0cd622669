"""Enrollments on the way to an award."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.functions.levels import DROPPED_GRADE
from laurel.functions.recode import safe_ratio
from laurel.sources.domain import SECTION_KEYS, Domain

def kept_enrollments(enrollments: DataFrame, current: int | None = None,
                     first: int | None = None) -> DataFrame:
    """Enrollments with a grade that counts, in [first, current) where bounds are given.

    No path starts before the first entry cohort. Stating that bound lets the scan skip
    older terms, which a comparison with each student's own cohort cannot do.
    """
    kept = enrollments.where(F.col("Grade") != DROPPED_GRADE)
    if current is not None:
        kept = kept.where(F.col("Year_Semester") < current)
    return kept if first is None else kept.where(F.col("Year_Semester") >= first)


SALTS = 16


def merged_by_key(rows: DataFrame) -> DataFrame:
    """Rows that are not broadcast in the next join, however small their files or shuffles look.

    For what has a row per student: in memory that is many times its compressed size, by which
    Spark decides.
    """
    return rows.hint("merge")


def of_students(enrollments: DataFrame, people: DataFrame) -> DataFrame:
    """Enrollments of the students in `people`, chosen before anything else is joined.

    Each student's enrollments are dealt to SALTS groups by section and term, so a student
    with a very large share of all rows doesn't end up in one task. The short list of
    students is repeated for that, and the next step shuffles by section anyway. The list is
    merged: repeated ids compress to almost nothing, so Spark would take it for small and
    broadcast it, which takes 80 bytes per student and group on the driver and in each task.
    """
    salt = F.pmod(F.xxhash64("Section_Number", "Year_Semester"), F.lit(SALTS)).cast("int")
    spread = people.select("Student_Id").distinct().select(
        "Student_Id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return enrollments.withColumn("_salt", salt).join(merged_by_key(spread), ["Student_Id", "_salt"], "left_semi").drop("_salt")


def join_enrollment_section(enrollments: DataFrame, sections: DataFrame, *columns: str) -> DataFrame:
    """Attach section columns; enrollments without a section stay.

    A section with a very large share of the rows is left to adaptive skew splitting:
    the next step groups by other keys, so splitting adds no shuffle.
    """
    return enrollments.join(sections.select(*SECTION_KEYS, *columns), SECTION_KEYS, "left")


def joined_enrollments(domain: Domain, sections: DataFrame, people: DataFrame, current: int | None,
                       first: int | None, *columns: str, how: str = "left") -> DataFrame:
    """Counting enrollments of `people` with section columns, by the cheaper way.

    With a copy of the enrollments that is stored by section, sections are joined first, where
    both lie. Otherwise people are chosen first, so that fewer enrollments are shuffled.
    """
    sections = sections.select(*SECTION_KEYS, *columns)
    if domain.by_section is not None:
        beside = kept_enrollments(domain.by_section, current, first).join(sections, SECTION_KEYS, how)
        return of_students(beside, people)
    chosen = of_students(kept_enrollments(domain.enrollments, current, first), people)
    return chosen.join(sections, SECTION_KEYS, how)


def section_effort(sections: DataFrame) -> DataFrame:
    """Student and faculty load per enrolled student of a section."""
    seats = F.nullif("Enrollment", F.lit(0))
    return sections.select(
        *SECTION_KEYS,
        safe_ratio(F.col("FTES"), seats).alias("FTES"),
        safe_ratio(safe_ratio(F.col("Standard_Hours"), F.col("Teaching_Load")), seats).alias("FTEF"),
    )


def term_effort(enrollments: DataFrame, sections: DataFrame, current: int,
                first: int | None = None, people: DataFrame | None = None) -> DataFrame:
    """Teaching effort and number of enrollments per student, college and term.

    With `people`, of their enrollments only. The sum combines map-side, so a student with a
    large share of all enrollments arrives in the per-student steps as a few rows per term.
    """
    kept = kept_enrollments(enrollments, current, first)
    kept = kept if people is None else of_students(kept, people)
    return sum_effort(join_enrollment_section(kept, section_effort(sections), "FTES", "FTEF"))


def sum_effort(joined: DataFrame) -> DataFrame:
    return joined.groupBy("Student_Id", "College", "Year_Semester").agg(
        F.sum("FTES").alias("FTES"), F.sum("FTEF").alias("FTEF"),
        F.count(F.lit(1)).alias("Enrollments"),
    )


PATH = ["Student_Id", "College", "Cohort"]


def path_terms(effort: DataFrame, completers: DataFrame) -> DataFrame:
    """Effort per term on each path, from entry on.

    `completers` has one row per path: Student_Id, Cohort and the college of the award. A
    student who entered two colleges has a path at each. Sections of other colleges carry
    no effort, but the enrollment still puts the student on the path.
    """
    homes = completers.withColumnRenamed("College", "Home_College")
    path = effort.join(homes, "Student_Id", "inner").where(F.col("Year_Semester") >= F.col("Cohort"))
    own = F.col("College") == F.col("Home_College")
    return path.groupBy("Student_Id", "Home_College", "Cohort", "Year_Semester").agg(
        F.sum(F.when(own, F.col("FTES"))).alias("FTES"),
        F.sum(F.when(own, F.col("FTEF"))).alias("FTEF"),
        F.sum("Enrollments").alias("Enrollments"),
    ).withColumnRenamed("Home_College", "College")


def join_path_totals(awards: DataFrame, terms: DataFrame) -> DataFrame:
    """Effort of the path up to the term of each award.

    Awards and `path_terms` are stacked and summed by one window per path, so no award is
    paired with the terms before it. An award row stands for `Weight` awards, which all
    count the path. Awards without any path enrollment drop out.
    """
    marked = awards.withColumn("_award", F.lit(True))
    stacked = marked.unionByName(terms.withColumn("_award", F.lit(False)), allowMissingColumns=True)
    so_far = W.partitionBy(*PATH).orderBy("Year_Semester")  # by value: the award's term counts
    running = {c: F.sum(c).over(so_far) for c in ("FTES", "FTEF", "Enrollments")}
    return stacked.select(
        *awards.columns, "_award",
        (running["FTES"] * F.col("Weight")).alias("FTES"),
        (running["FTEF"] * F.col("Weight")).alias("FTEF"),
        running["Enrollments"].alias("Enrollments"),
    ).where(F.col("_award") & F.col("Enrollments").isNotNull()).drop("_award")
