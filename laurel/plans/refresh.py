"""Completer reports that are kept up to date by term.

The cells of a report are stored in one partition per award term. When awards arrive, are taken back or
corrected, only the terms they fall in, late ones too, are counted anew and their partitions replaced;
the files of other terms stay. Reports of any split and time scale are made of the stored cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import terms as T
from laurel.functions.recode import award_name, known_ethnicity, recode_gender
from laurel.operators import awards as A
from laurel.operators.counting import running_count
from laurel.operators.modes import STRATA
from laurel.operators.selection import ACADEMIC_YEAR, UNSPLIT, Period, Strata, filter_award_types
from laurel.plans.datasets import COLLEGES
from laurel.plans.reports import completers_report
from laurel.sources.calendar import Calendar
from laurel.sources.domain import Domain

TERM = "Year_Semester"
CELL = ["College", "Major_Code", "Award_Type", *STRATA]


def award_cells(domain: Domain, calendar: Calendar, terms: Sequence[int] | None = None,
                majors: Sequence[str] | None = None, colleges: Sequence[str] = COLLEGES) -> DataFrame:
    """Awards per term and cell, up to the current term; of the given terms only.

    Terms are stated as date bounds, one range per run of terms, so the scan reads just those.
    """
    awards = A.distinct_awards(domain, colleges, majors)
    if terms is None:
        first = calendar.rows[0].term if calendar.rows else calendar.current_term
        inside = calendar.date_within_terms("Award_Date", first, calendar.current_term)
    else:
        inside = F.lit(False)
        for low, high in calendar.runs([t for t in terms if t <= calendar.current_term]):
            inside = inside | calendar.date_within_terms("Award_Date", low, high)
    dated = calendar.with_term_as_of(awards.where(inside), "Award_Date", TERM)
    people = A.join_award_student(dated, domain.students)
    return people.select(
        TERM, "College", "Major_Code", award_name(F.col("Award_Type")).alias("Award_Type"),
        recode_gender(F.col("Gender")).alias("Gender"), known_ethnicity(F.col("Ethnicity")).alias("Ethnicity"),
    ).groupBy(TERM, *CELL).agg(F.count(F.lit(1)).alias("Count"))


class CompleterStore:
    """Stored cells of the completer reports, by term."""

    def __init__(self, spark: SparkSession, path: str, majors: Sequence[str] | None = None,
                 colleges: Sequence[str] = COLLEGES):
        self.spark, self.path, self.majors, self.colleges = spark, path, majors, colleges

    def _write(self, cells: DataFrame, terms: Sequence[int] = ()) -> None:
        """Replace the partitions of `cells` and `terms`. A term without awards gets an empty cell, as
        only partitions with a row are replaced."""
        empty = self.spark.createDataFrame([(t, 0) for t in terms], f"{TERM} int, Count long")
        # A term's cells are few and go to one file; other terms are left alone.
        cells.unionByName(empty, allowMissingColumns=True).repartition(TERM).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            TERM).parquet(self.path)

    def build(self, domain: Domain, calendar: Calendar) -> None:
        """Count all terms."""
        self._write(award_cells(domain, calendar, None, self.majors, self.colleges))

    def touched(self, changed: DataFrame, calendar: Calendar, counted_until: int) -> list[int]:
        """Terms to count anew: those of the changed award rows, and those begun after `counted_until`,
        the current term of the last run. At most as many as the calendar has."""
        dated = calendar.with_term_as_of(changed.select("Award_Date").distinct(), "Award_Date", TERM)
        terms = {r[TERM] for r in dated.select(TERM).distinct().collect()} - {None}
        return sorted(terms | {r.term for r in calendar.rows if counted_until < r.term <= calendar.current_term})

    def refresh(self, domain: Domain, calendar: Calendar, changed: DataFrame, counted_until: int) -> list[int]:
        """Bring the cells up to date and return the terms counted anew.

        `domain` holds all awards as they are now. `changed` holds the rows that have arrived since
        and those that were taken back; a corrected row is in it as it was and as it is.
        """
        terms = self.touched(changed, calendar, counted_until)
        if terms:
            self._write(award_cells(domain, calendar, terms, self.majors, self.colleges), terms)
        return terms

    def cells(self, calendar: Calendar, years: int = 6) -> DataFrame:
        """Stored cells of the report's window; its terms choose the partitions that are read."""
        first = calendar.award_cutoff(years)
        stored = self.spark.read.parquet(self.path).where(
            F.col(TERM).between(first, calendar.current_term) & (F.col("Count") > 0))
        term = F.col(TERM)
        year = calendar.labelled_year(T.academic_year(term), T.academic_year_of(first))
        return stored.select(*CELL, "Count", calendar.labelled_term(term, first).alias("Year_Semester_Key"),
                             year.alias("Academic_Year_Key"))

    def report(self, calendar: Calendar, period: Period = ACADEMIC_YEAR, strata: Strata = UNSPLIT,
               award_types: Sequence[str] | None = None, cumulative: bool = False, fill: bool = True,
               years: int = 6) -> DataFrame:
        """`report_completers` of all completers, from the stored cells."""
        chosen = strata.apply(filter_award_types(self.cells(calendar, years), award_types))
        series = ["Award_Type", *strata.columns]
        counts = chosen.groupBy(*series, period.key).agg(F.sum("Count").alias("Count"))
        if cumulative:
            counts = running_count(counts, period.key, series)
        return completers_report(counts, period, strata, (), fill)
