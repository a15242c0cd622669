"""Completion analytics on Spark: who completed what, how fast and on which path."""

from laurel.operators.bitmaps import number_students
from laurel.operators.selection import (
    ACADEMIC_YEAR, AWARD_TERM, COMPLETION_COHORT, UNSPLIT, Period, Strata,
)
from laurel.plans.datasets import (
    active_program_names, award_groups, awards_all, awards_cohort, course_completers, course_patterns, course_rules,
    course_takers, course_taking, efficiency,
    program_codes, rolling_cohorts, rolling_spans, survival_person_period, top_program_courses,
)
from laurel.plans.refresh import CompleterStore
from laurel.plans.reports import (
    change_in_people, completers, distinct_completers, efficiency_series, report_change_completers,
    report_change_completers_modes, report_change_efficiency, report_change_time, report_completers,
    report_completers_modes, report_course_taking, report_course_taking_modes, report_online,
    report_sgec, report_time_to_award, time_boxplot, time_density, time_histogram,
)
from laurel.sources.calendar import Calendar
from laurel.sources.derive import derive_domain
from laurel.sources.domain import SCHEMAS, Domain
from laurel.sources.sinks import report_columns, write_report

__all__ = [
    "ACADEMIC_YEAR", "AWARD_TERM", "COMPLETION_COHORT", "SCHEMAS", "UNSPLIT", "Calendar",
    "Domain", "Period", "Strata", "active_program_names", "award_groups", "awards_all",
    "awards_cohort", "change_in_people", "completers", "course_completers", "course_patterns",
    "course_rules", "course_takers", "course_taking", "derive_domain", "distinct_completers",
    "efficiency", "efficiency_series", "number_students", "program_codes",
    "report_change_completers", "report_change_completers_modes", "report_change_efficiency",
    "report_change_time", "report_columns", "report_completers", "report_completers_modes",
    "report_course_taking", "report_course_taking_modes", "report_online", "report_sgec",
    "report_time_to_award", "rolling_cohorts", "rolling_spans", "survival_person_period",
    "time_boxplot", "time_density", "time_histogram", "top_program_courses", "write_report",
]
