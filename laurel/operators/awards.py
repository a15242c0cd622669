"""Award rows with their term, cohort, demographics and study history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.functions.recode import safe_ratio
from laurel.operators.selection import among, filter_cohort_window, filter_program
from laurel.sources.calendar import Calendar
from laurel.sources.domain import Domain

AWARD_KEYS = ["Student_Id", "College", "Major_Code", "Award_Type", "Award_Date"]


def record_keys(colleges: Sequence[str]) -> list[str]:
    """Keys of a student's record at the selected colleges.

    With one college the student alone is enough. Joins and windows of a plan then share
    one partitioning by student instead of being shuffled again for each key set.
    """
    return ["Student_Id"] if len(colleges) == 1 else ["Student_Id", "College"]


def distinct_awards(domain: Domain, colleges: Sequence[str],
                    majors: Sequence[str] | None = None) -> DataFrame:
    """One row per student, program and date.

    Deduplicating first also disarms a student with a huge share of the award rows:
    partial aggregation leaves at most one row per program and day.
    """
    return filter_program(domain.awards, colleges, majors).select(*AWARD_KEYS).distinct()


def entry_cohorts(domain: Domain, first: int, current: int, colleges: Sequence[str],
                  include_current: bool = False) -> DataFrame:
    chosen = filter_cohort_window(domain.cohorts, first, current, include_current)
    return chosen.where(among("Cohort_College", colleges))


def join_award_student(awards: DataFrame, students: DataFrame) -> DataFrame:
    return awards.join(students.select("Student_Id", "Gender", "Ethnicity"), "Student_Id", "left")


def join_award_cohort(awards: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Entry term of the student at whatever college, if known."""
    return awards.join(cohorts.select("Student_Id", "Cohort"), "Student_Id", "left")


def join_entry_cohort(awards: DataFrame, cohorts: DataFrame, colleges: Sequence[str]) -> DataFrame:
    """Awards of students who entered the awarding college.

    Both sides must already be restricted to `colleges`.
    """
    keys = record_keys(colleges)
    entered = cohorts.withColumnRenamed("Cohort_College", "College").select(*keys, "Cohort")
    return awards.join(entered, keys, "inner")


def student_entries(cohorts: DataFrame) -> DataFrame:
    """(Student_Id, _entries): the entry terms and colleges of each student in one row.

    Equal entries are counted first, so what is gathered for a student is bounded by calendar
    and colleges; a repeated entry is listed as often as it is there.
    """
    entry = F.struct("Cohort", "Cohort_College")
    counted = cohorts.groupBy("Student_Id", "Cohort", "Cohort_College").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return counted.groupBy("Student_Id").agg(
        F.flatten(F.collect_list(F.array_repeat(entry, F.col("_n")))).alias("_entries"))


def join_award_program(awards: DataFrame, programs: DataFrame) -> DataFrame:
    keys = ["College", "Major_Code", "Award_Type", "Catalog_Year"]
    return awards.join(programs.select(*keys, "Major", "Final_Term"), keys, "left")


UNITS = ["SGEC_Units", "Online_Units", "Units_Attempted"]


def dated_units(profiles: DataFrame, calendar: Calendar, colleges: Sequence[str]) -> DataFrame:
    """Units of each student record per term, with the start of the term as `Since`.

    Profiles are reduced to one row per term, so a record has at most one row per calendar
    term.
    """
    keys = record_keys(colleges)
    per_term = profiles.where(among("College", colleges)).groupBy(*keys, "Year_Semester").agg(
        *[F.sum(u).alias(u) for u in UNITS]
    )
    return per_term.join(
        calendar.start_dates(), F.col("Year_Semester") == F.col("Calendar_Term"), "inner"
    ).select(*keys, F.col("Calendar_Start").alias("Since"), *UNITS)


def join_cumulative_units(awards: DataFrame, history: DataFrame, colleges: Sequence[str]) -> DataFrame:
    """Unit totals of all terms started by the award date; NULL without any.

    Awards and terms are stacked and summed by one window in date order, so no award is
    paired with the terms before it. `history` comes from `dated_units`.
    """
    keys = record_keys(colleges)
    marked = awards.withColumns({"_award": F.lit(True), "_day": F.col("Award_Date")})
    terms = history.withColumn("_award", F.lit(False)).withColumnRenamed("Since", "_day")
    so_far = W.partitionBy(*keys).orderBy("_day")  # by value: terms started on the day count
    stacked = marked.unionByName(terms, allowMissingColumns=True)
    return stacked.select(
        *awards.columns, "_award", *[F.sum(u).over(so_far).alias(u) for u in UNITS]
    ).where("_award").drop("_award")


def with_unit_shares(awards: DataFrame) -> DataFrame:
    """Replace the unit totals by their shares of the attempted units."""
    attempted = F.col("Units_Attempted")
    return awards.withColumns({
        "SGEC_Units": safe_ratio(F.col("SGEC_Units"), attempted),
        "Online_Units": safe_ratio(F.col("Online_Units"), attempted),
    }).drop("Units_Attempted")


def active_programs(programs: DataFrame, colleges: Sequence[str],
                    majors: Sequence[str] | None = None) -> DataFrame:
    """Programs none of whose catalog rows has an end term."""
    return (
        filter_program(programs, colleges, majors)
        .groupBy("College", "Major_Code", "Award_Type")
        .agg(F.max("Final_Term").alias("Final_Term"))
        .where(F.col("Final_Term").isNull())
        .drop("Final_Term")
    )


def join_active_programs(awards: DataFrame, active: DataFrame) -> DataFrame:
    keys = ["College", "Major_Code", "Award_Type"]
    return awards.join(active, keys, "left_semi")
