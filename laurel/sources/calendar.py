"""The term calendar: the current term, cut-offs derived from it, and as-of lookup."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import terms as T
from laurel.sources.domain import Domain

# A term code has five digits, so a calendar of distinct codes cannot be larger.
MAX_CODES = 100_000


@dataclass(frozen=True)
class CalendarRow:
    term: int
    start: dt.date


class Calendar:
    """Distinct term codes with their first start date, held on the driver.

    Only one row per term code is fetched, and the size is checked, so it stays small
    however large the other tables grow. Cut-offs become literals in the plans and
    reach the scans as pushed filters.
    """

    def __init__(self, spark: SparkSession, rows: list[CalendarRow], current_term: int):
        self.spark = spark
        self.rows = rows
        self.current_term = current_term

    @classmethod
    def load(cls, domain: Domain, as_of: dt.date, college: str = "E") -> Calendar:
        """`as_of` stands for today; the current term is the last one started in `college`."""
        first_start = F.min("Term_Start_Date")
        own_start = F.min(F.when(F.col("College") == college, F.col("Term_Start_Date")))
        fetched = (
            domain.terms.groupBy("Year_Semester")
            .agg(first_start.alias("start"), own_start.alias("own_start"))
            .limit(MAX_CODES + 1)
            .collect()
        )
        if len(fetched) > MAX_CODES:
            raise ValueError("the terms table holds more distinct codes than five digits allow")
        started = [r["Year_Semester"] for r in fetched
                   if r["own_start"] is not None and r["own_start"] <= as_of]
        if not started:
            raise ValueError(f"no term of college {college!r} has started by {as_of}")
        rows = [CalendarRow(r["Year_Semester"], r["start"]) for r in fetched if r["start"] is not None]
        return cls(domain.spark, sorted(rows, key=lambda r: (r.start, r.term)), max(started))

    def years_back(self, years: int) -> int:
        return self.current_term - years * 10

    @property
    def current_academic_year(self) -> int:
        return T.academic_year_of(self.current_term)

    def academic_year_back(self, years: int) -> int:
        return T.academic_year_of(self.years_back(years))

    def award_cutoff(self, years: int) -> int:
        """Summer term that opens the academic year `years` back."""
        return self.academic_year_back(years) // 10000 * 10 + 2

    @cached_property
    def _starts(self) -> pa.Table:
        return pa.table({
            "Calendar_Term": pa.array([r.term for r in self.rows], pa.int32()),
            "Calendar_Start": pa.array([r.start for r in self.rows], pa.date32()),
        })

    def start_dates(self) -> DataFrame:
        """(Calendar_Term, Calendar_Start), bounded by MAX_CODES and so safe to broadcast."""
        return F.broadcast(self.spark.createDataFrame(self._starts))

    @cached_property
    def _intervals(self) -> pa.Table:
        """[start, next start) per term, repeated for each calendar year it touches.

        The term of an interval is the largest code started so far, which is what a
        maximum over all earlier starts gives, even if starts and codes disagree. The
        last interval is open: later years are folded into its first year by `_bucket`.
        """
        last_year = self.rows[-1].start.year
        years, lows, highs, codes = [], [], [], []
        best = 0
        for position, row in enumerate(self.rows):
            best = max(best, row.term)
            is_last = position + 1 == len(self.rows)
            high = None if is_last else self.rows[position + 1].start
            for year in range(row.start.year, (last_year if is_last else high.year) + 1):
                years.append(year)
                lows.append(row.start)
                highs.append(high)
                codes.append(best)
        return pa.table({
            "Bucket": pa.array(years, pa.int32()),
            "Low": pa.array(lows, pa.date32()),
            "High": pa.array(highs, pa.date32()),
            "As_Of_Term": pa.array(codes, pa.int32()),
        })

    def with_term_as_of(self, df: DataFrame, date: str, name: str) -> DataFrame:
        """Add the term running at `date`; NULL before the first start.

        A left as-of join: intervals are bucketed by year, so each row is compared with
        the few intervals of its own year in a broadcast hash join, never with all terms.
        """
        if not self.rows:
            return df.withColumn(name, F.lit(None).cast("int"))
        intervals = F.broadcast(self.spark.createDataFrame(self._intervals))
        day = F.col(date)
        bucket = F.least(F.year(day), F.lit(self.rows[-1].start.year))
        running = (
            (bucket == F.col("Bucket"))
            & (day >= F.col("Low"))
            & (F.col("High").isNull() | (day < F.col("High")))
        )
        return (
            df.join(intervals, running, "left")
            .withColumnRenamed("As_Of_Term", name)
            .drop("Bucket", "Low", "High")
        )

    def date_within_terms(self, date: str, first: int, last: int) -> Column:
        """Condition on a date that holds exactly if its as-of term is in [first, last].

        As plain date bounds it is pushed down to the scan, unlike the looked-up term.
        """
        opened = [r.start for r in self.rows if r.term >= first]
        closed = [r.start for r in self.rows if r.term > last]
        if not opened:
            return F.lit(False)
        inside = F.col(date) >= F.lit(min(opened))
        return inside & (F.col(date) < F.lit(min(closed))) if closed else inside

    def runs(self, terms: Sequence[int]) -> list[tuple[int, int]]:
        """Terms as ranges (first, last) without other terms of the calendar in between."""
        wanted, found = set(terms), []
        open_run = None
        for code in sorted({r.term for r in self.rows} | wanted):
            if code not in wanted:
                open_run = None
            elif open_run is None:
                open_run = len(found)
                found.append((code, code))
            else:
                found[open_run] = (found[open_run][0], code)
        return found

    def labelled_term(self, term: Column, first: int) -> Column:
        """The term itself if it lies in [first, current], else NULL (not a known level)."""
        return F.when(term.between(first, self.current_term) & T.is_regular_term(term), term)

    def labelled_year(self, year: Column, first: int) -> Column:
        return F.when(year.between(first, self.current_academic_year), year)
