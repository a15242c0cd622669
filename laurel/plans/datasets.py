"""The analysis data sets the reports are built on, one lazy plan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.functions import terms as T
from laurel.functions.levels import ALL_COMPLETERS, SIX_YEAR_COHORT
from laurel.functions.recode import (
    award_name, indicator_flags, known_ethnicity, pad_code, recode_gender, safe_name,
)
from laurel.operators import awards as A
from laurel.operators import courses as C
from laurel.operators import mining as M
from laurel.operators import survival as S
from laurel.operators.paths import (
    join_path_totals, joined_enrollments, merged_by_key, path_terms, section_effort, sum_effort,
)
from laurel.operators.rolling import END, START, cohorts_of_span, with_span, without_overlap
from laurel.operators.selection import among, drop_incomplete, filter_catalog_window
from laurel.sources.calendar import Calendar
from laurel.sources.domain import Domain
from laurel.sources.storage import cut_lineage

COLLEGES = ("E",)

# Optional parts of the award data sets. Each is a join that adds columns and keeps the
# rows, so a report that reads none of the columns should leave the part out.
STUDENT, COHORT, UNITS = "student", "cohort", "units"
DETAILS = (STUDENT, COHORT, UNITS)
PERSON = "person"  # the student's id, for counts of people


def active_program_names(domain: Domain, calendar: Calendar, colleges: Sequence[str] = COLLEGES,
                         years: int = 6) -> DataFrame:
    """Latest name of every major with a running program in the catalog window."""
    # Stepping back `years` academic years lowers both halves of the eight-digit code.
    first = calendar.current_academic_year - years * 10001
    offered = filter_catalog_window(
        domain.programs.where(among("College", colleges)),
        first, calendar.current_academic_year, calendar.current_term,
    )
    latest = W.partitionBy("Major_Code").orderBy(F.col("Catalog_Year").desc(), "Major")
    return (
        offered.withColumn("row", F.row_number().over(latest))
        .where(F.col("row") == 1)
        .select(pad_code(F.col("Major_Code")).alias("Major_Code"), "Major")
    )


def program_codes(domain: Domain, calendar: Calendar, names: Sequence[str],
                  colleges: Sequence[str] = COLLEGES, years: int = 6) -> DataFrame:
    """Major codes behind the chosen program names."""
    known = active_program_names(domain, calendar, colleges, years)
    return known.where(F.col("Major").isin(list(names))).select("Major_Code")


def _award_report_rows(awards: DataFrame, domain: Domain, calendar: Calendar, first_term: int,
                       colleges: Sequence[str], details: Sequence[str]) -> DataFrame:
    """Last steps shared by the two award data sets: details, recodes, labels."""
    columns = []
    if UNITS in details:
        history = A.dated_units(domain.student_profiles, calendar, colleges)
        awards = A.with_unit_shares(A.join_cumulative_units(awards, history, colleges))
        columns += [F.col("SGEC_Units"), F.col("Online_Units")]
    if STUDENT in details:
        awards = A.join_award_student(awards, domain.students)
        columns += [
            recode_gender(F.col("Gender")).alias("Gender"),
            known_ethnicity(F.col("Ethnicity")).alias("Ethnicity"),
        ]
    if PERSON in details:
        columns.append(F.col("Student_Id"))
    term = F.col("Year_Semester")
    if COHORT in details:
        if "Cohort" not in awards.columns:
            awards = A.join_award_cohort(awards, domain.cohorts)
        columns += [
            F.col("Cohort"), T.terms_between(term, F.col("Cohort")).alias("Terms_to_Complete"),
        ]
    year = calendar.labelled_year(T.academic_year(term), T.academic_year_of(first_term))
    shown = calendar.labelled_term(term, first_term)
    return awards.select(
        "College", "Major_Code",
        award_name(F.col("Award_Type")).alias("Award_Type"),
        shown.alias("Year_Semester_Key"),
        T.term_label(shown).alias("Year_Semester"),
        year.alias("Academic_Year_Key"),
        T.academic_year_label(year).alias("Academic_Year"),
        *columns,
    )


def awards_all(domain: Domain, calendar: Calendar, majors: Sequence[str] | None = None,
               colleges: Sequence[str] = COLLEGES, years: int = 6,
               details: Sequence[str] = DETAILS) -> DataFrame:
    """Every award of the last `years` academic years."""
    first = calendar.award_cutoff(years)
    chosen = A.distinct_awards(domain, colleges, majors)
    chosen = chosen.where(calendar.date_within_terms("Award_Date", first, calendar.current_term))
    awards = calendar.with_term_as_of(chosen, "Award_Date", "Year_Semester")
    return _award_report_rows(awards, domain, calendar, first, colleges, details)


def awards_cohort(domain: Domain, calendar: Calendar, majors: Sequence[str] | None = None,
                  colleges: Sequence[str] = COLLEGES, years: int = 6,
                  details: Sequence[str] = DETAILS) -> DataFrame:
    """Awards of the students who entered the awarding college in the last `years` years."""
    first = calendar.years_back(years)
    cohorts = A.entry_cohorts(domain, first, calendar.current_term, colleges)
    awards = A.join_entry_cohort(A.distinct_awards(domain, colleges, majors), cohorts, colleges)
    awards = calendar.with_term_as_of(awards, "Award_Date", "Year_Semester")
    return _award_report_rows(awards, domain, calendar, first, colleges, details)


def award_groups(domain: Domain, calendar: Calendar, majors: Sequence[str] | None = None,
                 colleges: Sequence[str] = COLLEGES, years: int = 6,
                 details: Sequence[str] = DETAILS) -> DataFrame:
    """The rows of `awards_all` and `awards_cohort` under a Group column, for reports on both.

    Every table is read once. An award carries the student's entry terms until all details are
    attached; then it is listed for each group it is in, once per entry term as there.
    """
    first_all, first_cohort = calendar.award_cutoff(years), calendar.years_back(years)
    awards = calendar.with_term_as_of(
        A.distinct_awards(domain, colleges, majors), "Award_Date", "Year_Semester")
    awards = awards.join(A.student_entries(domain.cohorts), "Student_Id", "left")
    entries = F.coalesce("_entries", F.array())
    own = F.filter(entries, lambda e: (e["Cohort_College"] == F.col("College"))
                   & (e["Cohort"] >= first_cohort) & (e["Cohort"] < calendar.current_term))
    in_window = F.coalesce(
        calendar.date_within_terms("Award_Date", first_all, calendar.current_term), F.lit(False))
    awards = awards.withColumns({"_in_window": in_window, "_own": own, "_entries": entries}).where(
        F.col("_in_window") | (F.size("_own") > 0))
    columns = []
    if UNITS in details:
        history = A.dated_units(domain.student_profiles, calendar, colleges)
        awards = A.with_unit_shares(A.join_cumulative_units(awards, history, colleges))
        columns += [F.col("SGEC_Units"), F.col("Online_Units")]
    if STUDENT in details:
        awards = A.join_award_student(awards, domain.students)
        columns += [
            recode_gender(F.col("Gender")).alias("Gender"),
            known_ethnicity(F.col("Ethnicity")).alias("Ethnicity"),
        ]
    if PERSON in details:
        columns.append(F.col("Student_Id"))
    term = F.col("Year_Semester")

    def member(group: str, first: int, cohort: Column) -> Column:
        year = calendar.labelled_year(T.academic_year(term), T.academic_year_of(first))
        return F.struct(F.lit(group).alias("Group"), cohort.alias("Cohort"),
                        calendar.labelled_term(term, first).alias("Year_Semester_Key"),
                        year.alias("Academic_Year_Key"))

    unknown = F.array(member(ALL_COMPLETERS, first_all, F.lit(None).cast("int")))
    everyone = unknown
    if COHORT in details:
        listed = F.transform("_entries", lambda e: member(ALL_COMPLETERS, first_all, e["Cohort"]))
        everyone = F.when(F.size("_entries") > 0, listed).otherwise(unknown)
        columns += [F.col("_in.Cohort"), T.terms_between(term, F.col("_in.Cohort")).alias("Terms_to_Complete")]
    entrants = F.transform("_own", lambda e: member(SIX_YEAR_COHORT, first_cohort, e["Cohort"]))
    groups = F.concat(F.when(F.col("_in_window"), everyone).otherwise(F.slice(unknown, 1, 0)), entrants)
    return awards.withColumn("_in", F.explode(groups)).select(
        "_in.Group", "College", "Major_Code",
        award_name(F.col("Award_Type")).alias("Award_Type"),
        "_in.Year_Semester_Key", T.term_label(F.col("_in.Year_Semester_Key")).alias("Year_Semester"),
        "_in.Academic_Year_Key", T.academic_year_label(F.col("_in.Academic_Year_Key")).alias("Academic_Year"),
        *columns,
    )


def cohort_award_terms(domain: Domain, calendar: Calendar, majors: Sequence[str] | None,
                       colleges: Sequence[str], cohort_length: int, look_back: int,
                       countable: bool = False) -> DataFrame:
    """Awards in active programs by students of the (looked-back) entry cohorts.

    With `countable`, only awards whose term can lie in a completion cohort: not before the
    first entry cohort and before the last completion cohort. These are bounds on the
    award date, which reach the scan.
    """
    first = calendar.years_back(cohort_length) - look_back * 10
    active = A.active_programs(domain.programs, colleges, majors)
    awards = A.distinct_awards(domain, colleges, majors)
    if countable:
        awards = awards.where(calendar.date_within_terms("Award_Date", first, calendar.current_term - 2))
    awards = A.join_active_programs(awards, active)
    cohorts = A.entry_cohorts(domain, first, calendar.current_term, colleges)
    awards = A.join_entry_cohort(awards, cohorts, colleges)
    return calendar.with_term_as_of(awards, "Award_Date", "Year_Semester")


def rolling_spans(domain: Domain, calendar: Calendar, majors: Sequence[str] | None = None,
                  colleges: Sequence[str] = COLLEGES, cohort_length: int = 6,
                  look_back: int = 7, person: bool = False) -> DataFrame:
    """One row per award with the run of completion cohorts it counts in.

    This is what the reports on change are made of; `rolling_cohorts` lists the same as a row
    per award and cohort. With `person` the student's id is kept, for counts of people.
    """
    first = calendar.years_back(cohort_length)
    awards = cohort_award_terms(domain, calendar, majors, colleges, cohort_length, look_back, countable=True)
    awards = A.join_award_student(awards, domain.students)
    complete = drop_incomplete(
        awards.select("Student_Id", "Cohort", "College", "Major_Code", "Award_Type", "Year_Semester",
                      "Gender", "Ethnicity")
    )
    spans = with_span(complete, first, calendar.current_term, cohort_length)
    return spans.select(
        "College", "Major_Code",
        award_name(F.col("Award_Type")).alias("Award_Type"),
        recode_gender(F.col("Gender")).alias("Gender"),
        known_ethnicity(F.col("Ethnicity")).alias("Ethnicity"),
        T.terms_between(F.col("Year_Semester"), F.col("Cohort")).alias("Terms_to_Complete"),
        START, END, *(["Student_Id"] if person else []),
    )


def rolling_cohorts(domain: Domain, calendar: Calendar, majors: Sequence[str] | None = None,
                    colleges: Sequence[str] = COLLEGES, cohort_length: int = 6,
                    look_back: int = 7) -> DataFrame:
    """One row per award and completion cohort it counts in."""
    spans = rolling_spans(domain, calendar, majors, colleges, cohort_length, look_back)
    completion = T.term_of_index(F.col("_at"))
    return spans.select("*", F.explode(cohorts_of_span()).alias("_at")).select(
        completion.alias("Completion_Cohort_Key"),
        T.term_label(completion).alias("Completion_Cohort"),
        "College", "Major_Code", "Award_Type", "Gender", "Ethnicity", "Terms_to_Complete",
        T.term_season(completion).alias("Term"),
    )


def efficiency(domain: Domain, calendar: Calendar, majors: Sequence[str] | None = None,
               colleges: Sequence[str] = COLLEGES, cohort_length: int = 6,
               look_back: int = 7) -> DataFrame:
    """Completers and the teaching effort of their paths, per completion cohort.

    Sums are taken per program and run of cohorts before cohorts are listed, so no award is
    repeated. A student counts once per program and cohort: of overlapping runs only the part
    that no earlier one covers counts people (`without_overlap`).
    """
    first, current = calendar.years_back(cohort_length), calendar.current_term
    dated = cohort_award_terms(domain, calendar, majors, colleges, cohort_length, look_back, countable=True)
    # Awards of one program and term follow the same path; they only weigh more.
    awards = dated.groupBy("Student_Id", "College", "Major_Code", "Award_Type", "Cohort",
                           "Year_Semester").agg(F.count(F.lit(1)).alias("Weight"))
    completers = awards.select("Student_Id", "College", "Cohort").distinct()
    effort = sum_effort(joined_enrollments(
        domain, section_effort(domain.sections2), completers, current, first - look_back * 10, "FTES", "FTEF"))
    paths = join_path_totals(awards, path_terms(effort, completers))
    program = ["College", "Major_Code", "Award_Type"]
    spans = without_overlap(with_span(paths, first, current, cohort_length), ["Student_Id", *program])
    runs = spans.groupBy(*program, START, END, "Fresh").agg(
        F.count(F.lit(1)).alias("People"), F.sum("FTES").alias("FTES"), F.sum("FTEF").alias("FTEF"))
    listed = runs.select("*", F.explode(cohorts_of_span()).alias("_at"))
    fte_students, fte_faculty = F.sum("FTES"), F.sum("FTEF")
    groups = listed.groupBy("_at", *program).agg(
        F.sum(F.when(F.col("_at") >= F.col("Fresh"), F.col("People")).otherwise(0)).alias("Completers"),
        fte_students.alias("FTES"),
        fte_faculty.alias("FTEF"),
        F.try_divide(fte_students, fte_faculty).alias("Efficiency"),
    )
    completion = T.term_of_index(F.col("_at"))
    return drop_incomplete(groups).select(
        completion.alias("Completion_Cohort_Key"),
        T.term_label(completion).alias("Completion_Cohort"),
        "College", "Major_Code",
        award_name(F.col("Award_Type")).alias("Award_Type"),
        "Completers", "FTES", "FTEF", "Efficiency",
        T.term_season(completion).alias("Term"),
    )


def course_takers(domain: Domain, calendar: Calendar, majors: Sequence[str] | None = None,
                  colleges: Sequence[str] = COLLEGES, years: int = 6) -> DataFrame:
    """One row per completer, course and program of the entry cohorts in the window."""
    people = _program_completers(domain, calendar, majors, colleges, years)
    return _takers(domain, calendar, people, years)


def _program_completers(domain: Domain, calendar: Calendar, majors: Sequence[str] | None,
                        colleges: Sequence[str], years: int) -> DataFrame:
    cohorts = A.entry_cohorts(domain, calendar.years_back(years), calendar.current_term, colleges)
    completed = C.completed_programs(domain, cohorts, colleges, majors)
    return A.join_award_student(completed, merged_by_key(domain.students))


def _takers(domain: Domain, calendar: Calendar, people: DataFrame, years: int) -> DataFrame:
    takers = C.courses_since_entry(
        domain, people, calendar.current_term, calendar.years_back(years), ["Gender", "Ethnicity"])
    return takers.select("Discipline", "Course", *_program_columns())


def course_taking(domain: Domain, calendar: Calendar, majors: Sequence[str] | None = None,
                  colleges: Sequence[str] = COLLEGES, years: int = 6) -> tuple[DataFrame, DataFrame]:
    """`course_takers` and `course_completers` of one stored table of completers.

    A report on course taking reads both. Completers are few beside the enrollments; storing
    them saves reading awards, cohorts and students again for every use.
    """
    people = cut_lineage(_program_completers(domain, calendar, majors, colleges, years))
    return _takers(domain, calendar, people, years), people.select(*_program_columns(), "Weight")


def course_completers(domain: Domain, calendar: Calendar, majors: Sequence[str] | None = None,
                      colleges: Sequence[str] = COLLEGES, years: int = 6) -> DataFrame:
    """The completers `course_takers` starts from: a row per student and program, with the
    number of award days as Weight. Group sizes are sums of it."""
    people = _program_completers(domain, calendar, majors, colleges, years)
    return people.select(*_program_columns(), "Weight")


def _program_columns() -> list[Column]:
    return [
        F.col("College"), F.col("Major_Code"),
        award_name(F.col("Award_Type")).alias("Award_Type"),
        recode_gender(F.col("Gender")).alias("Gender"),
        known_ethnicity(F.col("Ethnicity")).alias("Ethnicity"),
    ]


def top_program_courses(domain: Domain, calendar: Calendar, major: str, award_type: str,
                        college: str = "E", years: int = 6, cohort_end: int | None = None,
                        count_cutoff: int = 25,
                        special_courses: Sequence[str] = tuple(C.SPECIAL_COURSES)) -> DataFrame:
    """The most-taken courses of a program, then the always-listed special courses."""
    end = calendar.current_term if cohort_end is None else cohort_end
    cohorts = A.entry_cohorts(domain, end - years * 10, end, [college])
    counts = C.program_course_counts(domain, cohorts, end, college, major, award_type, end - years * 10)
    top = C.top_courses(counts, count_cutoff, special_courses)
    return C.append_courses(top, special_courses, count_cutoff)


def course_rules(domain: Domain, calendar: Calendar, majors: Sequence[str] | None = None,
                 colleges: Sequence[str] = COLLEGES, years: int = 6,
                 success_cutoff: float = 0.75, failure_cutoff: float = 0.5,
                 min_students: int = 5, confidence: float = 0.8,
                 max_items: int | None = None) -> DataFrame:
    """Pruned rule tables for all, successful and unsuccessful student terms, told apart by Set.

    Baskets are mined once; they, their itemsets and the lattice are all that is stored.
    """
    baskets = stored_baskets(domain, calendar, majors, colleges, years)
    sets = M.basket_sets(success_cutoff, failure_cutoff)
    lattice = cut_lineage(M.itemset_lattice(M.frequent_itemsets(baskets, sets, min_students)))
    return M.rules_table(M.prune_rules(M.lattice_rules(lattice, confidence, max_items)))


def course_patterns(*args, **options) -> dict[str, DataFrame]:
    """`course_rules` as a table per set of baskets."""
    rules = course_rules(*args, **options)
    return {name: rules.where(F.col("Set") == name).drop("Set")
            for name in (M.ALL_BASKETS, *M.basket_sets())}


def stored_baskets(domain: Domain, calendar: Calendar, majors: Sequence[str] | None = None,
                   colleges: Sequence[str] = COLLEGES, years: int = 6, item: str = "Course") -> DataFrame:
    """Baskets of `item` with the completion ratio, computed and stored.

    Enrollments, sections and profiles may all come from one join; it is made once.
    """
    courses = M.courses_taken(domain, calendar, majors, colleges, years, item)
    with domain.held():
        return cut_lineage(M.course_baskets(courses, M.term_completion_ratio(domain.student_profiles)))


def survival_person_period(domain: Domain, calendar: Calendar, major: str, award_type: str,
                           courses: Sequence[str], college: str = "E", years: int = 6,
                           cohort_end: int | None = None,
                           first_course_term: int | None = None) -> DataFrame:
    """Counting-process rows of the entry cohorts for one program.

    Rows before `first_course_term`, if given, count no courses. Terms are counted from entry. Everything is keyed on Student_Id, and all running
    values come from one window over the table rows and the course passes.
    """
    end = calendar.current_term if cohort_end is None else cohort_end
    cohorts = A.entry_cohorts(domain, end - years * 10, end, [college])
    profiles = S.cohort_profiles(cohorts, domain.student_profiles, college)
    passes = S.course_pivot_counts(S.passed_courses(domain, courses, end, cohorts), cohorts, courses)
    stacked = S.stack_course_events(profiles.where(F.col("Year_Semester") < end), passes, courses)
    kept = F.coalesce(S.after_entry(), F.lit(False))  # course rows have no entry term
    table = stacked.select(
        "Student_Id", "Year_Semester", "Cohort",
        (F.col("Term_Age") - 18).alias("Term_Age"),
        "Education_Goal", "Residency_Status", "Military", "DSPS",
        (F.col("District_Cumulative_GPA") - 2.0).alias("GPA"),
        *S.entry_columns(major),
        S.previous_term(kept).alias("Previous_Year_Semester"),
        *S.running_aid_terms(kept),
        S.running_average_award(kept).alias("Total_Award"),
        *S.cumulative_courses(courses, first_course_term),
        kept.alias("_kept"),
    ).where("_kept").drop("_kept")

    award_terms = S.student_award_term(domain, calendar, college, major, award_type)
    rows = S.first_award_row(S.join_award_reached(table, award_terms)).drop("Award_Year_Semester")
    # The windows have dealt the rows by student, so merging costs them no shuffle.
    rows = rows.join(merged_by_key(domain.students), "Student_Id", "left")
    rows = rows.join(merged_by_key(domain.ethnicity_details), "Student_Id", "left")
    details = [c for c in domain.ethnicity_details.columns if c != "Student_Id"]
    return rows.select(
        "Student_Id",
        T.terms_between(F.col("Year_Semester"), F.col("Cohort")).alias("Year_Semester"),
        T.terms_between(F.col("Previous_Year_Semester"), F.col("Cohort"))
        .alias("Previous_Year_Semester"),
        "Cohort", "Term_Age", *indicator_flags(), "Military", "DSPS",
        *S.RUNNING_TOTALS, "Total_Award", "Declared_Major_at_Entry", "GPA",
        "Former_Concurrent_Student", "Former_PSA_Student", "Foster_Youth",
        *details, *map(safe_name, courses), "Earned_Award",
    )


def sort_person_period(table: DataFrame) -> DataFrame:
    """Display order; only for a sink that needs it."""
    return table.orderBy("Student_Id", "Year_Semester")
