"""Row selections the reports offer, and the split into strata."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import levels as L
from laurel.functions import terms as T
from laurel.functions.recode import stratum_label


def among(column: str, values: Sequence | None) -> Column:
    """`column` IN values; None selects everything."""
    return F.lit(True) if values is None else F.col(column).isin(list(values))


def filter_program(df: DataFrame, colleges: Sequence[str], majors: Sequence[str] | None,
                   college_column: str = "College") -> DataFrame:
    chosen = df.where(among(college_column, colleges))
    return chosen if majors is None else chosen.where(among("Major_Code", majors))


def filter_award_types(df: DataFrame, award_types: Sequence[str] | None) -> DataFrame:
    return df if award_types is None else df.where(among("Award_Type", award_types))


def filter_season(df: DataFrame, seasons: Sequence[str] | None, column: str = "Term") -> DataFrame:
    return df if seasons is None else df.where(among(column, seasons))


def filter_cohort_window(df: DataFrame, first: int, current: int,
                         include_current: bool = False) -> DataFrame:
    cohort = F.col("Cohort")
    upper = cohort <= current if include_current else cohort < current
    return df.where((cohort >= first) & upper)


def filter_catalog_window(programs: DataFrame, first_year: int, last_year: int,
                          current_term: int) -> DataFrame:
    """Catalog rows of the window whose program has not ended before the current term."""
    final = F.col("Final_Term")
    return programs.where(
        F.col("Catalog_Year").between(first_year, last_year)
        & (final.isNull() | (final >= current_term))
    )


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns is not None else None)


# A report on the time to an award counts rows that have all of these.
TIME_REPORT_COLUMNS = ["Gender", "Ethnicity", "Cohort", "SGEC_Units", "Online_Units",
                       "Year_Semester", "Academic_Year", "Terms_to_Complete"]


def complete_awards(awards: DataFrame) -> DataFrame:
    """Award rows without a gap in the columns above, all of which must be there."""
    missing = [c for c in TIME_REPORT_COLUMNS if c not in awards.columns]
    if missing:
        raise ValueError(f"the time reports need award rows with {', '.join(missing)}")
    return drop_incomplete(awards, TIME_REPORT_COLUMNS)


def filter_completion_band(df: DataFrame, at_least: float | None = None,
                           at_most: float | None = None) -> DataFrame:
    if at_least is not None:
        df = df.where(F.col("Completion") >= at_least)
    if at_most is not None:
        df = df.where(F.col("Completion") <= at_most)
    return df


def filter_excluded_courses(df: DataFrame, courses: Sequence[str]) -> DataFrame:
    """SQL's NOT IN: a missing course goes as well."""
    return df.where(~F.col("Course").isin(list(courses)))


def filter_min_group(df: DataFrame, smallest: int) -> DataFrame:
    return df.where(F.col("Group_Size") >= smallest)


@dataclass(frozen=True)
class Strata:
    """Selected genders and ethnicities; an empty selection neither filters nor splits."""

    genders: tuple[str, ...] = ()
    ethnicities: tuple[str, ...] = ()

    @classmethod
    def by_gender(cls) -> Strata:
        return cls(genders=tuple(L.GENDERS))

    @classmethod
    def by_ethnicity(cls) -> Strata:
        return cls(ethnicities=tuple(L.ETHNICITIES))

    @classmethod
    def by_both(cls) -> Strata:
        return cls(genders=tuple(L.GENDERS), ethnicities=tuple(L.ETHNICITIES))

    @property
    def column(self) -> str | None:
        if self.genders and self.ethnicities:
            return "Ethnicity_Gender"
        if self.genders:
            return "Gender"
        return "Ethnicity" if self.ethnicities else None

    @property
    def columns(self) -> list[str]:
        return [self.column] if self.column else []

    @property
    def levels(self) -> list[str]:
        if self.genders and self.ethnicities:
            return [f"{e} {g}" for e in self.ethnicities for g in self.genders]
        return list(self.genders or self.ethnicities)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.genders:
            df = df.where(among("Gender", self.genders))
        if self.ethnicities:
            df = df.where(among("Ethnicity", self.ethnicities))
        if self.genders and self.ethnicities:
            df = df.withColumn("Ethnicity_Gender", stratum_label(F.col("Ethnicity"), F.col("Gender")))
        return df

    def known(self, df: DataFrame) -> DataFrame:
        """Keep rows whose stratum is one of the selected levels."""
        return df if self.column is None else df.where(among(self.column, self.levels))


UNSPLIT = Strata()


@dataclass(frozen=True)
class Period:
    """A time scale: an integer key to group and order by, and the label shown.

    Labels are added to finished cells, so the shuffles carry only the integer.
    """

    key: str
    label: str

    def shown(self) -> Column:
        text = T.academic_year_label if self.label == "Academic_Year" else T.term_label
        return text(F.col(self.key))

    def with_label(self, cells: DataFrame) -> DataFrame:
        return cells.withColumn(self.label, self.shown())


ACADEMIC_YEAR = Period("Academic_Year_Key", "Academic_Year")
AWARD_TERM = Period("Year_Semester_Key", "Year_Semester")
COMPLETION_COHORT = Period("Completion_Cohort_Key", "Completion_Cohort")
