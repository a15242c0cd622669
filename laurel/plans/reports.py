"""The eight reports, each one plan from data set to chart-ready rows.

All four split modes (none, gender, ethnicity, both) run through the same code; the
`Strata` argument carries selection and split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.functions.levels import ONLINE_STATUSES, SGEC_STATUSES
from laurel.functions.recode import round_measure, share_status
from laurel.functions.terms import term_season, years_from_terms
from laurel.operators import stats
from laurel.operators.bitmaps import bitmaps, count_people, merged
from laurel.operators.counting import (
    count_cells, label_groups, running_count, with_label, with_share,
)
from laurel.operators.courses import PROGRAM, course_distribution, course_heatmap, distribution_modes
from laurel.operators.gapfill import fill_observed
from laurel.operators.modes import STRATA, over_modes, which
from laurel.operators.rolling import END, START, count_by_cohort, without_overlap
from laurel.operators.selection import (
    ACADEMIC_YEAR, AWARD_TERM, COMPLETION_COHORT, UNSPLIT, Period, Strata, complete_awards,
    drop_incomplete, filter_award_types, filter_season,
)

# Completer group name -> award rows, or the rows of `award_groups`, which have a Group column.
Groups = Mapping[str, DataFrame] | DataFrame


def _group_column(groups: Groups) -> list[str]:
    return ["Group"] if isinstance(groups, DataFrame) or len(groups) > 1 else []


def completers(awards: DataFrame, period: Period = ACADEMIC_YEAR, strata: Strata = UNSPLIT,
               award_types: Sequence[str] | None = None, cumulative: bool = False,
               within: Sequence[str] = ()) -> DataFrame:
    """Completers per period and award type (and stratum), optionally as a running count."""
    chosen = strata.apply(filter_award_types(awards, award_types))
    series = [*within, "Award_Type", *strata.columns]
    cells = count_cells(chosen, [*series, period.key])
    return running_count(cells, period.key, series) if cumulative else cells


def _zero_filled(cells: DataFrame, period: Period, split: Sequence[str],
                 within: Sequence[str]) -> DataFrame:
    filled = fill_observed(cells, ["Award_Type", *split, period.key], ["Count", "Proportion"], within)
    return period.with_label(with_label(filled))


def report_completers(groups: Groups, period: Period = ACADEMIC_YEAR, strata: Strata = UNSPLIT,
                      award_types: Sequence[str] | None = None, cumulative: bool = False,
                      fill: bool = True) -> DataFrame:
    """Count and share of completers per period; the share is within award type and period."""
    within = _group_column(groups)
    cells = completers(label_groups(groups), period, strata, award_types, cumulative, within)
    return completers_report(cells, period, strata, within, fill)


def completers_report(cells: DataFrame, period: Period, strata: Strata, within: Sequence[str],
                      fill: bool) -> DataFrame:
    """Shares, zero cells and labels of finished counts."""
    cells = strata.known(cells)
    shares = with_share(cells, [*within, "Award_Type", period.key])
    if fill:
        return _zero_filled(shares, period, strata.columns, within)
    return period.with_label(shares)


def report_time_to_award(groups: Groups, strata: Strata = UNSPLIT,
                         award_types: Sequence[str] | None = None) -> DataFrame:
    """Count and share per years to completion, within award type (and stratum)."""
    within = _group_column(groups)
    complete = complete_awards(label_groups(groups))
    chosen = strata.apply(filter_award_types(complete, award_types))
    years = chosen.withColumn("Time_to_Complete", years_from_terms(F.col("Terms_to_Complete")))
    series = [*within, "Award_Type", *strata.columns]
    cells = count_cells(years, [*series, "Time_to_Complete"])
    return with_share(strata.known(cells), series)


def _report_status(groups: Groups, share: str, column: str, limit: float, labels: Sequence[str],
                   period: Period, award_types: Sequence[str] | None, fill: bool) -> DataFrame:
    within = _group_column(groups)
    known = drop_incomplete(filter_award_types(label_groups(groups), award_types), [share])
    status = known.withColumn(column, share_status(F.col(share), limit, labels))
    cells = count_cells(status, [*within, "Award_Type", period.key, column])
    shares = with_share(cells, [*within, "Award_Type", period.key])
    return _zero_filled(shares, period, [column], within) if fill else period.with_label(shares)


def report_sgec(groups: Groups, limit: float, period: Period = ACADEMIC_YEAR,
                award_types: Sequence[str] | None = None, fill: bool = True) -> DataFrame:
    """Completers with at least `limit` percent of their units off-site, and the others."""
    return _report_status(groups, "SGEC_Units", "SGEC_Status", limit, SGEC_STATUSES, period,
                          award_types, fill)


def report_online(groups: Groups, limit: float, period: Period = ACADEMIC_YEAR,
                  award_types: Sequence[str] | None = None, fill: bool = True) -> DataFrame:
    """Completers with at least `limit` percent of their units online, and the others."""
    return _report_status(groups, "Online_Units", "Online_Status", limit, ONLINE_STATUSES, period,
                          award_types, fill)


def _in_seasons(cells: DataFrame, seasons: Sequence[str] | None) -> DataFrame:
    """Cells of the completion cohorts in these seasons."""
    return cells if seasons is None else cells.where(
        term_season(F.col(COMPLETION_COHORT.key)).isin(list(seasons)))


def change_in_completers(spans: DataFrame, strata: Strata = UNSPLIT,
                         award_types: Sequence[str] | None = None,
                         seasons: Sequence[str] | None = None) -> DataFrame:
    """Completers per completion cohort and award type (and stratum) from `rolling_spans`."""
    chosen = strata.apply(filter_award_types(spans, award_types))
    return _in_seasons(count_by_cohort(chosen, ["Award_Type", *strata.columns]), seasons)


def sliding_histogram(spans: DataFrame, strata: Strata = UNSPLIT,
                      award_types: Sequence[str] | None = None,
                      seasons: Sequence[str] | None = None) -> DataFrame:
    """(Award_Type, stratum, Completion_Cohort_Key, Years, n): how many awards of each time are in
    the cohort's window. The window slides by the borders of `rolling_spans`, one sweep per time;
    medians and boxes follow from the counts."""
    chosen = strata.apply(filter_award_types(spans, award_types))
    timed = chosen.withColumn(stats.VALUE, years_from_terms(F.col("Terms_to_Complete")))
    weights = count_by_cohort(timed, ["Award_Type", *strata.columns, stats.VALUE], stats.WEIGHT)
    return _in_seasons(weights, seasons)


def change_shares(cells: DataFrame, strata: Strata = UNSPLIT) -> DataFrame:
    """Share within award type and completion cohort; 100 % when there is no split."""
    if strata.column is None:
        return with_label(cells.withColumn("Proportion", F.lit(1.0)))
    return with_share(strata.known(cells), ["Award_Type", COMPLETION_COHORT.key])


def report_change_completers(spans: DataFrame, strata: Strata = UNSPLIT,
                             award_types: Sequence[str] | None = None,
                             seasons: Sequence[str] | None = None) -> DataFrame:
    """Completers per completion cohort; zero cells are added only to a split report."""
    cells = change_in_completers(spans, strata, award_types, seasons)
    shares = change_shares(cells, strata)
    if strata.column is None:
        return COMPLETION_COHORT.with_label(shares)
    return _zero_filled(shares, COMPLETION_COHORT, strata.columns, [])


def report_change_efficiency(efficiency: DataFrame, award_types: Sequence[str] | None = None,
                             seasons: Sequence[str] | None = None) -> DataFrame:
    chosen = filter_season(filter_award_types(efficiency, award_types), seasons)
    rounded = {c: round_measure(F.col(c)) for c in ("FTES", "FTEF", "Efficiency")}
    return chosen.withColumns(rounded).drop("College", "Major_Code", "Term")


def efficiency_series(efficiency: DataFrame, award_types: Sequence[str] | None = None,
                      seasons: Sequence[str] | None = None) -> DataFrame:
    """Rounded efficiency per completion cohort and award type, zero-filled per program major."""
    chosen = filter_season(filter_award_types(efficiency, award_types), seasons)
    measures = ["Completers", "FTES", "FTEF", "Efficiency"]
    rounded = chosen.withColumns({c: round_measure(F.col(c)) for c in measures[1:]})
    filled = fill_observed(rounded, ["Award_Type", COMPLETION_COHORT.key], measures,
                           ["College", "Major_Code"])
    return COMPLETION_COHORT.with_label(filled)


def report_change_time(spans: DataFrame, strata: Strata = UNSPLIT,
                       award_types: Sequence[str] | None = None,
                       seasons: Sequence[str] | None = None) -> DataFrame:
    """Group size and median years to award per completion cohort.

    Unsplit, `Median_Years_Overall` repeats the median over all rows of the report.
    """
    weights = sliding_histogram(spans, strata, award_types, seasons)
    keys = ["Award_Type", *strata.columns, COMPLETION_COHORT.key]
    medians = stats.weighted_medians(weights, keys, overall=strata.column is None)
    return COMPLETION_COHORT.with_label(strata.known(medians))


def time_boxplot(spans: DataFrame, strata: Strata = UNSPLIT,
                 award_types: Sequence[str] | None = None,
                 seasons: Sequence[str] | None = None) -> DataFrame:
    """Boxes of the years to award per completion cohort."""
    weights = sliding_histogram(spans, strata, award_types, seasons)
    boxes = stats.weighted_boxplot(weights, ["Award_Type", *strata.columns, COMPLETION_COHORT.key])
    return COMPLETION_COHORT.with_label(boxes)


def _complete_times(awards: DataFrame, strata: Strata, award_types: Sequence[str] | None) -> DataFrame:
    return strata.apply(filter_award_types(complete_awards(awards), award_types))


def time_histogram(awards: DataFrame, strata: Strata = UNSPLIT,
                   award_types: Sequence[str] | None = None) -> DataFrame:
    return stats.histogram(_complete_times(awards, strata, award_types), strata.columns)


def time_density(awards: DataFrame, strata: Strata = UNSPLIT, unit: str = "terms",
                 award_types: Sequence[str] | None = None) -> DataFrame:
    return stats.density(_complete_times(awards, strata, award_types), strata.columns, unit)


def report_course_taking(takers: DataFrame, students: DataFrame,
                         award_types: Sequence[str] | None = None, strata: Strata = UNSPLIT,
                         cutoff: float = 0.25, min_students: int = 3) -> DataFrame:
    """Heat map cells: share of completers who took each listed course."""
    return course_heatmap(
        course_distribution(takers, students, award_types, strata, cutoff, min_students), strata
    )


# --- all split modes at once ---------------------------------------------------------------

SCALES = {ACADEMIC_YEAR.key: ("academic_year", ACADEMIC_YEAR), AWARD_TERM.key: ("term", AWARD_TERM)}


def report_completers_modes(awards: DataFrame, award_types: Sequence[str] | None = None) -> DataFrame:
    """Completers per period in all split modes, by academic year and by term (Scale).

    Awards are counted once in cells; modes and scales are grouping sets over them.
    """
    keys = ["Award_Type", *STRATA, *SCALES]
    cells = count_cells(filter_award_types(awards, award_types), keys)
    counts = over_modes(cells, ["Award_Type"], [F.sum("Count").alias("Count")], list(SCALES))
    by = which(list(SCALES))
    scale, key, label = (F.coalesce(*parts) for parts in zip(*[
        (F.when(by == column, name), F.when(by == column, F.col(column)), F.when(by == column, period.shown()))
        for column, (name, period) in SCALES.items()]))
    told = counts.select("Mode", "Category", "Award_Type", scale.alias("Scale"), key.alias("Period_Key"),
                         label.alias("Period"), "Count")
    return with_share(told, ["Mode", "Scale", "Award_Type", "Period_Key"])


def report_change_completers_modes(spans: DataFrame, award_types: Sequence[str] | None = None,
                                   seasons: Sequence[str] | None = None) -> DataFrame:
    """Completers per completion cohort in all split modes: runs are counted once, the modes are
    grouping sets over the runs, and one sweep counts by cohort."""
    runs = count_cells(filter_award_types(spans, award_types), ["Award_Type", *STRATA, START, END], "Runs")
    split = over_modes(runs, ["Award_Type", START, END], [F.sum("Runs").alias("Runs")])
    cells = _in_seasons(count_by_cohort(split, ["Mode", "Category", "Award_Type"], weight="Runs"), seasons)
    return COMPLETION_COHORT.with_label(with_share(cells, ["Mode", "Award_Type", COMPLETION_COHORT.key]))


def report_course_taking_modes(takers: DataFrame, students: DataFrame,
                               award_types: Sequence[str] | None = None, cutoff: float = 0.25,
                               min_students: int = 3) -> DataFrame:
    """Heat map cells of all split modes."""
    listed = distribution_modes(takers, students, award_types, cutoff, min_students)
    return listed.select("Mode", *PROGRAM, "Category", "Course", "Proportion")


# --- people instead of awards --------------------------------------------------------------

ANY_AWARD, ALL_YEARS = "Any award", "All years"


def distinct_completers(awards: DataFrame, numbers: DataFrame) -> DataFrame:
    """People with an award per academic year and in the whole window, by award type and for any
    award, in all split modes.

    `awards` has Student_Id (detail "person"), `numbers` is `number_students`. Totals can't be added
    up, as people recur; they are merged from the bitmaps of the smallest cells.
    """
    cell = ["Award_Type", *STRATA, ACADEMIC_YEAR.key]
    known = awards.where(F.col(ACADEMIC_YEAR.key).isNotNull()).join(numbers, "Student_Id")
    maps = bitmaps(known, cell)
    rolled = F.array(*[
        F.struct(award.alias("Award_Type"), year.alias(ACADEMIC_YEAR.key))
        for award in (F.col("Award_Type"), F.lit(ANY_AWARD))
        for year in (F.col(ACADEMIC_YEAR.key), F.lit(0))
    ])
    totals = maps.select(*STRATA, "Bucket", "Bits", F.inline(rolled)).groupBy(*cell, "Bucket").agg(merged())
    split = over_modes(totals, ["Award_Type", ACADEMIC_YEAR.key, "Bucket"], [merged()])
    people = count_people(split, ["Mode", "Category", "Award_Type", ACADEMIC_YEAR.key])
    labelled = ACADEMIC_YEAR.with_label(people)
    label = F.when(F.col(ACADEMIC_YEAR.key) == 0, ALL_YEARS).otherwise(F.col(ACADEMIC_YEAR.label))
    return labelled.withColumn(ACADEMIC_YEAR.label, label)


def change_in_people(spans: DataFrame, award_types: Sequence[str] | None = None,
                     seasons: Sequence[str] | None = None) -> DataFrame:
    """People per completion cohort and award type in all split modes.

    `spans` has Student_Id (`rolling_spans` with `person`). A student counts once in a cohort,
    however many awards of the type the window holds.
    """
    chosen = filter_award_types(spans, award_types)
    # A student's runs of a type are few once repeats are gone, however many awards there are.
    runs = chosen.select("Student_Id", "Award_Type", *STRATA, START, END).distinct()
    parts = without_overlap(runs, ["Student_Id", "Award_Type"]).where(F.col("Fresh") < F.col(END))
    parts = parts.withColumn(START, F.col("Fresh"))
    cells = report_change_completers_modes(parts, None, seasons)
    return cells.drop("Proportion", "Proportion_Label").withColumnRenamed("Count", "People")
