"""Every registered query: the Spark plan, and the SQL it is compared with."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import laurel
from checks import sql as Q
from laurel.functions import levels as L
from laurel.functions import recode as R
from laurel.functions import terms as T
from laurel.operators import awards as A
from laurel.operators import counting as N
from laurel.operators import courses as C
from laurel.operators import gapfill as G
from laurel.operators import mining as M
from laurel.operators import paths as P
from laurel.operators import rolling as B
from laurel.operators import selection as X
from laurel.operators import survival as S
from laurel.plans import datasets as D
from laurel.plans import reports as V
from laurel.sources.storage import cut_lineage, shared_folder

AS_OF = dt.date.fromisoformat(Q.AS_OF)
COLLEGES = ("E",)
PATTERN = ["BOLT 100", "GEAR 108", "RING 102"]
SPECIAL = ["BOLT 100", "MATH 105"]
STATUS_LIMIT = 60
SPLITS = {
    "": X.UNSPLIT,
    "gender": X.Strata.by_gender(),
    "ethnicity": X.Strata.by_ethnicity(),
    "ethnicity_gender": X.Strata.by_both(),
}


class Session:
    """What a query gets: domain tables, calendar and the data sets on them."""

    def __init__(self, spark: SparkSession, domain: laurel.Domain):
        self.spark = spark
        self.domain = domain
        self._plans: dict[tuple, DataFrame] = {}

    @cached_property
    def calendar(self) -> laurel.Calendar:
        return laurel.Calendar.load(self.domain, AS_OF)

    @property
    def current(self) -> int:
        return self.calendar.current_term

    @property
    def first_cohort(self) -> int:
        return self.calendar.years_back(6)

    def _awards(self, name: str, details: tuple[str, ...]) -> DataFrame:
        key = (name, details)
        if key not in self._plans:
            self._plans[key] = getattr(D, name)(self.domain, self.calendar, details=details)
        return self._plans[key]

    @property
    def awards_all(self) -> DataFrame:
        return self._awards("awards_all", D.DETAILS)

    @property
    def awards_cohort(self) -> DataFrame:
        return self._awards("awards_cohort", D.DETAILS)

    def awards(self, *details: str) -> DataFrame:
        """All award rows with only the given parts."""
        return self._awards("awards_all", details)

    def completers(self, *details: str) -> dict[str, DataFrame]:
        return {L.ALL_COMPLETERS: self.awards(*details)}

    def groups(self, *details: str) -> DataFrame:
        return self._awards("award_groups", details)

    @cached_property
    def course_taking(self) -> tuple[DataFrame, DataFrame]:
        return D.course_taking(self.domain, self.calendar)

    @property
    def takers(self) -> DataFrame:
        return self.course_taking[0]

    @property
    def cohort_students(self) -> DataFrame:
        return self.course_taking[1]

    @cached_property
    def numbers(self) -> DataFrame:
        return cut_lineage(laurel.number_students(self.domain.students))

    @cached_property
    def rolling(self) -> DataFrame:
        return D.rolling_cohorts(self.domain, self.calendar)

    @cached_property
    def spans(self) -> DataFrame:
        return D.rolling_spans(self.domain, self.calendar)

    @cached_property
    def efficiency(self) -> DataFrame:
        return D.efficiency(self.domain, self.calendar)

    def entry_cohorts(self, include_current: bool = False) -> DataFrame:
        return A.entry_cohorts(self.domain, self.first_cohort, self.current, COLLEGES, include_current)

    def cohort_profiles(self) -> DataFrame:
        return S.cohort_profiles(self.entry_cohorts(), self.domain.student_profiles, "E")

    def table_rows(self) -> DataFrame:
        return S.spine(self.cohort_profiles(), self.current)

    @cached_property
    def baskets(self) -> DataFrame:
        return D.stored_baskets(self.domain, self.calendar)

    @cached_property
    def discipline_baskets(self) -> DataFrame:
        """Coarser baskets, which share more items and give rules with longer left sides."""
        return D.stored_baskets(self.domain, self.calendar, item="Discipline")

    @cached_property
    def lattice(self) -> DataFrame:
        """Itemsets of all, successful and unsuccessful terms, mined once for all rule queries."""
        return cut_lineage(M.itemset_lattice(M.frequent_itemsets(self.baskets, M.basket_sets())))

    @cached_property
    def discipline_lattice(self) -> DataFrame:
        return cut_lineage(M.itemset_lattice(M.frequent_itemsets(self.discipline_baskets)))


_SESSIONS: dict[tuple[str, str], Session] = {}


def session_for(spark: SparkSession, folder: str) -> Session:
    """One session per application and folder: the calendar is loaded and the data sets
    are planned once, as a dashboard would. Only plans are kept, no rows but the baskets."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SESSIONS:
        _SESSIONS[key] = Session(spark, laurel.derive_domain(spark, folder))
    return _SESSIONS[key]


@dataclass(frozen=True)
class Check:
    name: str
    plan: Callable[[Session], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def add(name: str, plan: Callable[[Session], DataFrame], sql: str | None, **changed: str) -> None:
    """`changed` replaces named sub-queries of the SQL."""
    if name in CHECKS:
        raise ValueError(f"{name} is registered twice")
    CHECKS[name] = Check(name, plan, None if sql is None else Q.compose(sql, changed))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles differ in their last bits with the order of rows."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def parts(strata: X.Strata) -> tuple[str, ...]:
    """Award details a count with this split reads."""
    return () if strata.column is None else (D.STUDENT,)


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return N.count_cells(df, keys, "n")


# --- sources and sinks -------------------------------------------------------------------

_TABLE_KEYS = {"terms": "Year_Semester", "programs": "Catalog_Year", "sections2": "Section_Number"}


def _scan_domain(s: Session) -> DataFrame:
    result = None
    for name in laurel.SCHEMAS:
        table = s.domain[name].agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
            F.sum(F.col(_TABLE_KEYS.get(name, "Student_Id")).cast("bigint")).alias("key_sum"),
        )
        result = table if result is None else result.unionByName(table)
    return result


add("scan_domain", _scan_domain, " union all ".join(
    f"select '{name}' table_name, count(*) n, cast(sum({_TABLE_KEYS.get(name, 'Student_Id')}) as bigint) key_sum from {name}"
    for name in laurel.SCHEMAS))

add("report_columns",
    lambda s: laurel.report_columns(laurel.report_completers(s.completers(), fill=False)),
    f"""select Award_Type "Award Type", Academic_Year "Academic Year", n "Count",
        n/sum(n) over (partition by Award_Type, Academic_Year) "Proportion",
        {Q.percent('n/sum(n) over (partition by Award_Type, Academic_Year)')} "Proportion Label"
        from (select Award_Type, Academic_Year, count(*) n from awards_all group by all) x""")

# --- scalar functions --------------------------------------------------------------------

def _term_function(column: str, function) -> Callable[[Session], DataFrame]:
    return lambda s: counted(
        s.domain.enrollments.withColumn(column, function(F.col("Year_Semester"))),
        "Year_Semester", column)


def _term_sql(column: str, expression: str) -> str:
    return f"select Year_Semester, {expression} {column}, count(*) n from enrollments group by all"


add("term_season", _term_function("Season", T.term_season),
    _term_sql("Season", Q.season("Year_Semester")))
add("term_label", _term_function("Label", T.term_label),
    _term_sql("Label", Q.term_label("Year_Semester")))
add("academic_year", _term_function("Academic_Year", T.academic_year),
    _term_sql("Academic_Year", Q.academic_year("Year_Semester")))
add("academic_year_label",
    _term_function("Label", lambda t: T.academic_year_label(T.academic_year(t))),
    _term_sql("Label", Q.year_label(Q.academic_year("Year_Semester"))))
add("award_name",
    lambda s: counted(s.domain.awards.withColumn("Award_Name", R.award_name(F.col("Award_Type"))),
                      "Award_Type", "Award_Name"),
    f"select Award_Type, {Q.award_name('Award_Type')} Award_Name, count(*) n from awards group by all")
add("terms_between",
    lambda s: counted(
        s.domain.student_profiles.join(s.domain.cohorts, "Student_Id")
        .withColumn("Terms", T.terms_between(F.col("Year_Semester"), F.col("Cohort"))),
        "Year_Semester", "Cohort", "Terms"),
    f"""select Year_Semester, Cohort, {Q.between('Year_Semester', 'Cohort')} Terms, count(*) n
        from student_profiles join cohorts using (Student_Id) group by all""")
add("years_to_complete",
    lambda s: counted(s.awards(D.COHORT).withColumn("Years", T.years_from_terms(F.col("Terms_to_Complete"))),
                      "Terms_to_Complete", "Years"),
    "select Terms_to_Complete, Terms_to_Complete/4.0::double as Years, count(*) n from awards_all group by all")
add("recode_gender",
    lambda s: s.domain.students.select("Student_Id", R.recode_gender(F.col("Gender")).alias("Gender")),
    f"select Student_Id, {Q.gender('Gender')} Gender from students")
add("restrict_levels",
    lambda s: s.domain.students.select(
        "Student_Id", R.restrict_levels(F.col("Ethnicity"), L.ETHNICITIES).alias("Ethnicity")),
    f"select Student_Id, {Q.ethnicity('Ethnicity')} Ethnicity from students")
add("stratum_label",
    lambda s: s.domain.students.select("Student_Id", R.stratum_label(
        R.known_ethnicity(F.col("Ethnicity")), R.recode_gender(F.col("Gender"))).alias("Stratum")),
    f"select Student_Id, {Q.ethnicity('Ethnicity')} || ' ' || {Q.gender('Gender')} Stratum from students")
add("pad_code",
    lambda s: counted(s.domain.awards.withColumn("Short", F.col("Major_Code").cast("int").cast("string"))
                      .withColumn("Padded", R.pad_code(F.col("Short"))), "Short", "Padded"),
    """select cast(cast(Major_Code as int) as varchar) Short,
       lpad(cast(cast(Major_Code as int) as varchar), 6, '0') Padded, count(*) n from awards group by all""")
add("share_status",
    lambda s: counted(
        X.drop_incomplete(s.awards(D.UNITS), ["SGEC_Units"]).withColumn(
            "Status", R.share_status(F.col("SGEC_Units"), STATUS_LIMIT, L.SGEC_STATUSES)),
        "SGEC_Units", "Status"),
    f"""select SGEC_Units, case when round(SGEC_Units*100,9) >= {STATUS_LIMIT} then 'SGEC student'
        else 'Not an SGEC student' end Status, count(*) n from awards_all where SGEC_Units is not null group by all""")
add("percent_label",
    lambda s: counted(s.awards(D.UNITS).withColumn("Label", R.percent_label(F.col("Online_Units"))),
                      "Online_Units", "Label"),
    f"select Online_Units, {Q.percent('Online_Units')} Label, count(*) n from awards_all group by all")
add("percent_parse",
    lambda s: counted(s.awards(D.UNITS).withColumn(
        "Percent", R.percent_parse(R.percent_label(F.col("Online_Units")))), "Percent"),
    f"""select try_cast(replace({Q.percent('Online_Units')}, ' %', '') as double) Percent, count(*) n
        from awards_all group by all""")
add("round_measures",
    lambda s: s.efficiency.select(
        "Completion_Cohort_Key", "Major_Code", "Award_Type",
        *[R.round_measure(F.col(c)).alias(c) for c in ("FTES", "FTEF", "Efficiency")]),
    """select Completion_Cohort_Key, Major_Code, Award_Type, round(FTES,2) FTES, round(FTEF,2) FTEF,
       round(Efficiency,2) Efficiency from efficiency""")
add("safe_identifier",
    lambda s: counted(s.domain.sections2.withColumn("Identifier", R.safe_identifier(F.col("Course"))),
                      "Course", "Identifier"),
    """select Course, replace(replace(Course,' ','_'),'.','_') Identifier, count(*) n from sections2 group by all""")


def _indicator_flags(s: Session) -> DataFrame:
    rows = s.domain.student_profiles.join(
        s.domain.students.select("Student_Id", "Gender", "Language"), "Student_Id", "left")
    declared = R.flag(F.col("Major_Code") == Q.MAJOR).alias("Declared_Major")
    flags = rows.select("Year_Semester", *R.indicator_flags(), declared)
    return flags.groupBy("Year_Semester").agg(*[F.sum(c).alias(c) for c in flags.columns[1:]])


add("indicator_flags", _indicator_flags,
    "select Year_Semester, " + ", ".join(
        f"count(*) filter ({test}) {name}" for name, test in Q.FLAGS.items())
    + f""", cast(sum(case when Major_Code='{Q.MAJOR}' then 1 else 0 end) as bigint) Declared_Major
       from student_profiles left join (select Student_Id, Gender, Language from students) s using (Student_Id)
       group by Year_Semester""")
add("null_nan_defaults",
    lambda s: counted(
        s.awards(D.COHORT, D.UNITS).withColumn("Raw", F.coalesce("SGEC_Units", F.lit(float("nan"))))
        .select(R.zero_if_nan(F.col("Raw")).alias("Share"),
                R.zero_if_missing(F.col("Cohort")).alias("Cohort")), "Share", "Cohort"),
    """select case when isnan(x) then 0.0::double else x end as Share, coalesce(Cohort, 0) Cohort, count(*) n
       from (select coalesce(SGEC_Units, 'nan'::double) x, Cohort from awards_all) group by all""")
add("safe_ratio",
    lambda s: rounded(s.domain.sections2.groupBy("Course").agg(
        F.sum(R.safe_ratio(F.col("FTES"), F.nullif("Enrollment", F.lit(0)))).alias("FTES_per_Seat"),
        F.count(R.safe_ratio(F.col("FTES"), F.col("Enrollment"))).alias("Sections")), "FTES_per_Seat"),
    """select Course, round(sum(FTES/nullif(Enrollment,0)),6) FTES_per_Seat,
       count(FTES/nullif(Enrollment,0)) Sections from sections2 group by Course""")
add("centered_measures",
    lambda s: counted(s.domain.student_profiles.select(
        (F.col("Term_Age") - 18).alias("Term_Age"),
        F.round(F.col("District_Cumulative_GPA") - 2.0, 6).alias("GPA")), "Term_Age", "GPA"),
    """select Term_Age-18 Term_Age, round(District_Cumulative_GPA-2.0,6) GPA, count(*) n
       from student_profiles group by all""")


def _term_levels(s: Session) -> DataFrame:
    """Valid award terms of the window with the awards earned in each."""
    first = s.calendar.award_cutoff(6)
    levels = s.spark.range(1).select(
        F.explode(T.term_range(F.lit(first), F.lit(s.current))).alias("Year_Semester_Key"))
    counts = N.count_cells(s.awards(), ["Year_Semester_Key"], "n")
    return levels.join(counts, "Year_Semester_Key", "left").select(
        "Year_Semester_Key", T.term_label(F.col("Year_Semester_Key")).alias("Label"),
        T.academic_year_label(T.academic_year(F.col("Year_Semester_Key"))).alias("Academic_Year"),
        R.zero_if_missing(F.col("n")).alias("n"))


add("term_levels", _term_levels,
    f"""select num Year_Semester_Key, {Q.term_label('num')} as Label,
        {Q.year_label(Q.academic_year('num'))} Academic_Year, coalesce(n,0) n
        from (select num from gen, par where num >= award_cut and num%10 < 4 union select t from par) l
        left join (select Year_Semester_Key, count(*) n from awards_all group by 1) a on num=Year_Semester_Key""")
add("course_term_id",
    lambda s: N.count_cells(M.student_term_courses(s.domain, s.calendar, None, COLLEGES, 6),
                            ["Student_Id", "Year_Semester"], "Courses"),
    """select Student_Id, Year_Semester, count(distinct Course) Courses from courses_raw
       group by Student_Id, Year_Semester""")

# --- filters -----------------------------------------------------------------------------

AA_AS = ["Associate in Arts", "Associate in Science"]
add("filter_award_types",
    lambda s: counted(X.filter_award_types(s.awards(), AA_AS), "Award_Type", "Academic_Year"),
    f"""select Award_Type, Academic_Year, count(*) n from awards_all where Award_Type in {Q.texts(AA_AS)} group by all""")


def _filter_strata(s: Session) -> DataFrame:
    some = X.Strata(genders=("Female",), ethnicities=("Asian", "White"))
    return counted(some.apply(s.awards(D.STUDENT)), "Ethnicity_Gender", "Academic_Year")


add("filter_strata", _filter_strata,
    """select Ethnicity || ' ' || Gender Ethnicity_Gender, Academic_Year, count(*) n from awards_all
       where Gender in ('Female') and Ethnicity in ('Asian','White') group by all""")
add("filter_season",
    lambda s: counted(X.filter_season(s.rolling, ["Fall", "Spring"]), "Completion_Cohort", "Term"),
    "select Completion_Cohort, Term, count(*) n from rolling where Term in ('Fall','Spring') group by all")
add("filter_program",
    lambda s: X.filter_program(s.domain.awards, ["E", "W"], ["000100", "000300"]).select(
        *A.AWARD_KEYS),
    """select Student_Id, College, Major_Code, Award_Type, Award_Date from awards
       where College in ('E','W') and Major_Code in ('000100','000300')""")
add("filter_award_window",
    lambda s: counted(s.calendar.with_term_as_of(
        s.domain.awards.where(s.calendar.date_within_terms(
            "Award_Date", s.calendar.award_cutoff(6), s.current)),
        "Award_Date", "Year_Semester"), "Award_Date", "Year_Semester"),
    """select Award_Date, ys Year_Semester, sum(k)::bigint n from
       (select Award_Date, k, max(Year_Semester) ys
        from (select Award_Date, count(*) k from awards group by 1) a
        left join terms on Award_Date >= Term_Start_Date group by 1, 2), par
       where ys >= award_cut and ys <= t group by all""")
add("filter_cohort_window",
    lambda s: X.filter_cohort_window(s.domain.cohorts, s.first_cohort, s.current, True)
    .withColumn("Is_Current", F.col("Cohort") == s.current),
    """select Student_Id, Cohort, Cohort_College, Cohort = t Is_Current from cohorts, par
       where Cohort >= coh_cut and Cohort <= t""")
add("filter_grades",
    lambda s: counted(P.join_enrollment_section(
        P.kept_enrollments(s.domain.enrollments), s.domain.sections2, "Noncredit")
        .where((F.col("Noncredit") == 0) & F.col("Grade").isin(L.PASSING_GRADES)),
        "Grade", "Year_Semester"),
    """select Grade, Year_Semester, count(*) n from enrollments
       join sections2 using (Section_Number, College, Year_Semester)
       where Grade <> 'E' and Noncredit = 0 and Grade in ('A','B','C','P') group by all""")
add("drop_incomplete",
    lambda s: counted(X.drop_incomplete(s.awards_all), "Award_Type", "Gender", "Ethnicity"),
    """select Award_Type, Gender, Ethnicity, count(*) n from awards_all
       where Gender is not null and Ethnicity is not null and Cohort is not null and SGEC_Units is not null
       and Online_Units is not null and Year_Semester is not null group by all""")
add("filter_completion_band",
    lambda s: X.filter_completion_band(M.term_completion_ratio(s.domain.student_profiles), 0.25, 0.75),
    """select Student_Id, Year_Semester, Completion from completion
       where Completion >= 0.25 and Completion <= 0.75""")
add("filter_excluded_courses",
    lambda s: counted(X.filter_excluded_courses(s.takers, SPECIAL), "Course"),
    f"select Course, count(*) n from takers where Course not in {Q.texts(SPECIAL)} group by all")
add("filter_min_group",
    lambda s: X.filter_min_group(C.group_sizes(s.cohort_students, X.Strata.by_both()), 3),
    f"""select College, Major_Code, Award_Type, Ethnicity_Gender, count(*) Group_Size
        from {Q.Split('ethnicity_gender').source('awards_cohort')} x group by all having count(*) >= 3""")
add("filter_observed_strata",
    lambda s: counted(SPLITS["ethnicity_gender"].known(s.awards(D.STUDENT).withColumn(
        "Ethnicity_Gender", R.stratum_label(F.col("Ethnicity"), F.col("Gender")))), "Ethnicity_Gender"),
    f"""select Ethnicity || ' ' || Gender Ethnicity_Gender, count(*) n from awards_all
        where Ethnicity in {Q.texts(Q.ETHNICITIES)} and Gender in {Q.texts(Q.GENDERS)} group by all""")
add("filter_catalog_window",
    lambda s: X.filter_catalog_window(
        s.domain.programs, s.calendar.current_academic_year - 60006,
        s.calendar.current_academic_year, s.current),
    """select programs.* from programs, par where Catalog_Year between ay_now-60006 and ay_now
       and (Final_Term is null or Final_Term >= t)""")

# --- joins -------------------------------------------------------------------------------

add("join_award_student",
    lambda s: A.join_award_student(s.domain.awards, s.domain.students),
    "select awards.*, Gender, Ethnicity from awards left join students using (Student_Id)")
add("join_award_program",
    lambda s: A.join_award_program(s.domain.awards, s.domain.programs),
    """select awards.*, Major, Final_Term from awards
       left join programs using (College, Major_Code, Award_Type, Catalog_Year)""")
add("join_award_term_asof",
    lambda s: s.calendar.with_term_as_of(A.distinct_awards(s.domain, ["E", "W"]),
                                         "Award_Date", "Year_Semester"),
    """select Student_Id, awards.College, Major_Code, Award_Type, Award_Date, max(Year_Semester) Year_Semester
       from awards left join terms on Award_Date >= Term_Start_Date group by all""")
add("join_cumulative_profile",
    lambda s: A.join_cumulative_units(
        A.distinct_awards(s.domain, ["E", "W"]),
        A.dated_units(s.domain.student_profiles, s.calendar, ["E", "W"]), ["E", "W"]),
    """select a.Student_Id, a.College, Major_Code, Award_Type, Award_Date,
       cast(sum(SGEC_Units) as bigint) SGEC_Units, cast(sum(Online_Units) as bigint) Online_Units,
       cast(sum(Units_Attempted) as bigint) Units_Attempted
       from (select distinct Student_Id, College, Major_Code, Award_Type, Award_Date from awards) a
       left join terms on Award_Date >= Term_Start_Date
       left join (select Student_Id, College, Year_Semester, SGEC_Units, Online_Units, Units_Attempted
                  from student_profiles) p
         on a.Student_Id=p.Student_Id and terms.Year_Semester=p.Year_Semester and a.College=p.College
       group by all""")


def _join_award_cohort(s: Session) -> DataFrame:
    """Inner join at the college of entry, for both colleges, and left join."""
    colleges = ["E", "W"]
    awards = A.distinct_awards(s.domain, colleges)
    inner = A.join_entry_cohort(awards, s.domain.cohorts, colleges).withColumn("Mode", F.lit("inner"))
    left = A.join_award_cohort(awards, s.domain.cohorts).withColumn("Mode", F.lit("left"))
    return inner.unionByName(left)


add("join_award_cohort", _join_award_cohort,
    """select distinct a.Student_Id, College, Major_Code, Award_Type, Award_Date, Cohort, 'inner' as Mode
       from awards a left join cohorts c on a.Student_Id=c.Student_Id where Cohort_College=College
       union all
       select distinct a.Student_Id, College, Major_Code, Award_Type, Award_Date, Cohort, 'left' as Mode
       from awards a left join cohorts c on a.Student_Id=c.Student_Id""")
add("join_active_programs",
    lambda s: A.join_active_programs(A.distinct_awards(s.domain, COLLEGES),
                                     A.active_programs(s.domain.programs, COLLEGES)),
    """select distinct Student_Id, awards.College, awards.Major_Code, awards.Award_Type, Award_Date from awards
       join active on awards.College=active.College and awards.Major_Code=active.Major_Code
       and awards.Award_Type=active.Award_Type""")


def _cohort_grid(s: Session) -> DataFrame:
    """The rolling rule as triples, each with the awards that fall under it."""
    grid = B.cohort_grid(s.spark, s.first_cohort, s.current, 6)
    awards = D.cohort_award_terms(s.domain, s.calendar, None, COLLEGES, 6, 7)
    counts = N.count_cells(awards, ["Cohort", "Year_Semester"], "Awards")
    return grid.join(counts, ["Cohort", "Year_Semester"], "left").withColumn(
        "Awards", R.zero_if_missing(F.col("Awards")))


add("join_cohort_grid", _cohort_grid,
    """select y.Cohort, y.Year_Semester, y.Completion_Cohort, coalesce(n,0) Awards from cohort_years y
       left join (select Cohort, Year_Semester, count(*) n from roll_sub group by all) r
       on y.Cohort=r.Cohort and y.Year_Semester=r.Year_Semester""")
add("join_rolling_cohort",
    lambda s: B.explode_completion_cohorts(
        D.cohort_award_terms(s.domain, s.calendar, None, COLLEGES, 6, 7), s.first_cohort, s.current, 6),
    """select Student_Id, Cohort, Completion_Cohort, College, Major_Code, Award_Type, Award_Date, Year_Semester
       from rolling_raw""")
add("join_enrollment_section",
    lambda s: counted(P.join_enrollment_section(
        s.domain.enrollments, s.domain.sections2, "Course", "Discipline", "Noncredit"),
        "College", "Year_Semester", "Discipline", "Course", "Noncredit"),
    """select e.College, e.Year_Semester, Discipline, Course, Noncredit, count(*) n from enrollments e
       left join sections2 x on e.Section_Number=x.Section_Number and e.College=x.College
       and e.Year_Semester=x.Year_Semester group by all""")


def _path_enrollments(s: Session) -> DataFrame:
    dated = D.cohort_award_terms(s.domain, s.calendar, None, COLLEGES, 6, 7)
    keys = ["Student_Id", "College", "Major_Code", "Award_Type", "Cohort", "Year_Semester"]
    awards = N.count_cells(dated, keys, "Weight")
    people = awards.select("Student_Id", "College", "Cohort").distinct()
    terms = P.path_terms(P.term_effort(s.domain.enrollments, s.domain.sections2, s.current), people)
    return rounded(P.join_path_totals(awards, terms), "FTES", "FTEF")


add("join_path_enrollments", _path_enrollments,
    """select * replace (round(FTES*Weight,6) as FTES, round(FTEF*Weight,6) as FTEF) from
       (select Student_Id, College, Major_Code, Award_Type, Cohort, Year_Semester, count(*) Weight
        from roll_sub group by all) join path using (Student_Id, College, Cohort, Year_Semester)""")
add("join_group_size",
    lambda s: C.course_counts(s.takers, SPLITS["gender"]).join(
        C.group_sizes(s.cohort_students, SPLITS["gender"]), [*C.PROGRAM, "Gender"], "left"),
    """select c.*, Group_Size from (select College, Major_Code, Award_Type, Gender, Course, count(*) "Count"
         from takers where Gender in ('Male','Female') group by all) c
       left join (select College, Major_Code, Award_Type, Gender, count(*) Group_Size from awards_cohort
         where Gender in ('Male','Female') group by all) g using (College, Major_Code, Award_Type, Gender)""")


def _course_shortlist(s: Session) -> DataFrame:
    return C.shortlist_courses(C.course_shares(s.takers, s.cohort_students, X.UNSPLIT), 0.25)


_SHARES = """(select College, Major_Code, Award_Type, Course, n "Count", Group_Size, n/Group_Size Proportion from
   (select College, Major_Code, Award_Type, Course, count(*) n from takers group by all) c left join
   (select College, Major_Code, Award_Type, count(*) Group_Size from awards_cohort group by all) g
   using (College, Major_Code, Award_Type))"""
add("join_course_shortlist", _course_shortlist,
    f"select * from {_SHARES} x where Proportion > 0.25")

_GRID = {"Award_Type": [*L.AWARD_NAMES.values(), L.UNKNOWN_AWARD], "Gender": L.GENDERS,
         "Term": L.SEASON_ORDER}
_GRID_VALUES = {"Award_Type": [*Q.AWARD_NAMES.values(), Q.UNKNOWN_AWARD], "Gender": Q.GENDERS, "Term": Q.SEASONS}
_GRID_SQL = " cross join ".join(
    f"(select unnest([{', '.join(chr(39) + v + chr(39) for v in values)}]) {name})"
    for name, values in _GRID_VALUES.items())
add("anti_missing_levels", lambda s: G.missing_levels(s.rolling, _GRID),
    f"""select g.* from (select * from {_GRID_SQL}) g anti join rolling r
        on g.Award_Type=r.Award_Type and g.Gender=r.Gender and g.Term=r.Term""")
add("join_prior_history",
    lambda s: S.prior_history(s.cohort_profiles()).select(
        "Student_Id", "Cohort", "Year_Semester", "PSA_Only", "Concurrent_Student"),
    """select Student_Id, Cohort, Year_Semester, PSA_Only, Concurrent_Student from studies
       where Year_Semester < Cohort""")
add("join_entry_term", lambda s: S.entry_term(s.cohort_profiles(), Q.MAJOR),
    "select * from at_entry")


def _award_terms(s: Session) -> DataFrame:
    return S.student_award_term(s.domain, s.calendar, "E", Q.MAJOR, Q.AWARD)


def _with_award(s: Session) -> DataFrame:
    return S.join_award_reached(s.table_rows(), _award_terms(s))


add("join_award_reached",
    lambda s: _with_award(s).select("Student_Id", "Year_Semester", "Award_Year_Semester", "Earned_Award"),
    "select Student_Id, Year_Semester, Award_Year_Semester, Earned_Award from flagged")


def _passes(s: Session) -> DataFrame:
    passed = S.passed_courses(s.domain, PATTERN, s.current)
    return S.course_pivot_counts(passed, s.entry_cohorts(), PATTERN)


def _cumulative_courses(s: Session) -> DataFrame:
    rows = s.table_rows().select("Student_Id", "Year_Semester")
    stacked = S.stack_course_events(rows, _passes(s), PATTERN)
    return stacked.select(
        "Student_Id", "Year_Semester", *S.cumulative_courses(PATTERN, Q.FIRST_COURSE_TERM), "_table_row",
    ).where("_table_row").drop("_table_row")


_PASS_NAMES = [c.replace(" ", "_") for c in PATTERN]
_PASSES_SO_FAR = ", ".join(
    f"""case when l.Year_Semester < {Q.FIRST_COURSE_TERM} or l.Year_Semester%10 > 3 then 0 else
    (select count(*) from passes p where p.Student_Id=l.Student_Id and p.Course='{c}'
     and p.Year_Semester <= l.Year_Semester) end {name}""" for c, name in zip(PATTERN, _PASS_NAMES))
add("join_cumulative_courses", _cumulative_courses,
    f"select Student_Id, Year_Semester, {_PASSES_SO_FAR} from later l")
_PROGRAM_NAMES = ["Program 000100 rev 2", "Program 000300 rev 2"]


def _program_codes(s: Session) -> DataFrame:
    codes = D.program_codes(s.domain, s.calendar, _PROGRAM_NAMES)
    return counted(s.domain.awards.join(codes, "Major_Code", "left_semi"), "Major_Code", "Award_Type")


add("program_codes", _program_codes,
    f"""select Major_Code, Award_Type, count(*) n from awards where Major_Code in
        (select Major_Code from active_majors where Major in {Q.texts(_PROGRAM_NAMES)}) group by all""")

# --- aggregations and windows on the award data sets --------------------------------------

def _both_periods(s: Session, strata: X.Strata, cumulative: bool) -> DataFrame:
    """Academic years and terms in one frame, marked by the time scale."""
    frames = []
    for scale, period in (("academic_year", X.ACADEMIC_YEAR), ("term", X.AWARD_TERM)):
        awards = s.awards(*parts(strata))
        cells = V.completers(awards, period, strata, cumulative=cumulative)
        frames.append(period.with_label(cells).withColumn("Scale", F.lit(scale)).withColumnsRenamed(
            {period.key: "Period_Key", period.label: "Period"}))
    return frames[0].unionByName(frames[1])


def _both_periods_sql(split: Q.Split, cumulative: bool) -> str:
    parts = []
    for scale, label in (("academic_year", "Academic_Year"), ("term", "Year_Semester")):
        running = (f"cast(sum(count(*)) over (partition by Award_Type, {split.keys} 1 order by {label}_Key "
                   "rows unbounded preceding) as bigint)")
        parts.append(
            f"""select '{scale}' as Scale, {split.keys} Award_Type, {label}_Key Period_Key, {label} Period,
            {running if cumulative else 'count(*)'} as "Count" from {split.source('awards_all')} x
            group by {split.keys} Award_Type, {label}_Key, {label}""")
    return " union all ".join(parts)


for mode in Q.MODES:
    split, strata = Q.Split(mode), SPLITS[mode]
    add(f"completers_by_{mode or 'period'}", lambda s, strata=strata: _both_periods(s, strata, False),
        _both_periods_sql(split, False))
    add(f"cumulative_completers{split.suffix}", lambda s, strata=strata: _both_periods(s, strata, True),
        _both_periods_sql(split, True))

_STATUS = {
    "sgec": ("SGEC", "an SGEC", "SGEC student"),
    "online": ("Online", "an online", "Online student"),
}


def _status_cells(name: str) -> str:
    column, article, yes = _STATUS[name]
    return f"""(select *, case when round({column}_Units*100,9) >= {STATUS_LIMIT} then '{yes}'
        else 'Not {article} student' end {column}_Status from GROUPED where {column}_Units is not null)"""


for name, (column, *_rest) in _STATUS.items():
    report = getattr(laurel, f"report_{name}")
    add(f"completers_by_{name}",
        lambda s, report=report: report(s.completers(D.UNITS), STATUS_LIMIT, fill=False),
        f"""select Award_Type, Academic_Year_Key, Academic_Year, {column}_Status, count(*) "Count",
            count(*)/sum(count(*)) over (partition by Award_Type, Academic_Year_Key) Proportion,
            {Q.percent('count(*)/sum(count(*)) over (partition by Award_Type, Academic_Year_Key)')} Proportion_Label
            from {_status_cells(name).replace('GROUPED', 'awards_all')} x
            group by Award_Type, Academic_Year_Key, Academic_Year, {column}_Status""")

add("unit_shares_at_award",
    lambda s: A.with_unit_shares(A.join_cumulative_units(
        A.distinct_awards(s.domain, COLLEGES),
        A.dated_units(s.domain.student_profiles, s.calendar, COLLEGES), COLLEGES)),
    """select Student_Id, College, Major_Code, Award_Type, Award_Date, SGEC_Units, Online_Units from all_raw""")
add("efficiency", lambda s: rounded(s.efficiency, "FTES", "FTEF", "Efficiency"),
    """select * replace (round(FTES,6) as FTES, round(FTEF,6) as FTEF, round(Efficiency,6) as Efficiency)
       from efficiency""")

for mode in Q.MODES:
    split, strata = Q.Split(mode), SPLITS[mode]
    source = split.source("rolling")
    keys = f"Award_Type, {split.keys} Completion_Cohort_Key, Completion_Cohort"
    add(f"change_in_completers{split.suffix}",
        lambda s, strata=strata: X.COMPLETION_COHORT.with_label(V.change_in_completers(s.spans, strata)),
        f'select {keys}, count(*) "Count" from {source} x group by {keys}')
    overall = "" if mode else ", (select median(Terms_to_Complete/4.0::double) from rolling) Median_Years_Overall"
    add(f"median_time_to_award{split.suffix}",
        lambda s, strata=strata: V.report_change_time(s.spans, strata),
        f"""select {keys}, count(*) Group_Size, median(Terms_to_Complete/4.0::double) Median_Years{overall}
            from {source} x group by {keys}""")
    add(f"time_boxplot{split.suffix}",
        lambda s, strata=strata: _boxplot(s, strata),
        f"""with q as (select {keys}, Years, quantile_cont(Years,0.25) over w q1, median(Years) over w q2,
              quantile_cont(Years,0.75) over w q3, count(*) over w n
              from (select *, Terms_to_Complete/4.0::double as Years from {source}) x
              window w as (partition by {keys}))
            select {keys}, n Group_Size, q1 Lower_Hinge, q2 Median_Years, q3 Upper_Hinge,
              min(Years) filter (Years between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)) Lower_Whisker,
              max(Years) filter (Years between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)) Upper_Whisker,
              count(*) filter (Years not between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)) Outlier_Count,
              coalesce(string_agg(distinct printf('%.2f', Years), '|' order by printf('%.2f', Years))
                filter (Years not between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)), '') Outliers
            from q group by {keys}, n, q1, q2, q3""")


def _boxplot(s: Session, strata: X.Strata) -> DataFrame:
    """Outliers as text, because the comparison wants flat columns."""
    boxes = laurel.time_boxplot(s.spans, strata)
    values = F.array_sort(F.transform("Outliers", lambda v: F.format_string("%.2f", v["value"])))
    return boxes.withColumn("Outliers", F.array_join(values, "|"))


add("active_programs", lambda s: A.active_programs(s.domain.programs, COLLEGES),
    "select College, Major_Code, Award_Type from active")
add("term_completion_ratio", lambda s: M.term_completion_ratio(s.domain.student_profiles),
    "select Student_Id, Year_Semester, Completion from completion")
add("distinct_course_takers",
    lambda s: C.distinct_course_takers(s.domain, s.entry_cohorts(), s.current, COLLEGES, None),
    "select Student_Id, Discipline, Course, College, Major_Code, Award_Type from takers_raw")
add("course_counts", lambda s: C.course_counts(s.takers, SPLITS["ethnicity"]),
    f"""select College, Major_Code, Award_Type, Ethnicity, Course, count(*) "Count"
        from {Q.Split('ethnicity').source('takers')} x group by all""")
add("group_sizes", lambda s: C.group_sizes(s.cohort_students, SPLITS["gender"]),
    f"""select College, Major_Code, Award_Type, Gender, count(*) Group_Size
        from {Q.Split('gender').source('awards_cohort')} x group by all""")
add("max_course_share",
    lambda s: C.max_course_share(C.course_shares(s.takers, s.cohort_students, SPLITS["gender"])),
    f"""select College, Major_Code, Award_Type, Course,
        case when count(*)=count(p) then max(p) end Max_Proportion from
        (select College, Major_Code, Award_Type, Course, n/Group_Size p from
          (select College, Major_Code, Award_Type, Gender, Course, count(*) n
           from {Q.Split('gender').source('takers')} x group by all) c left join
          (select College, Major_Code, Award_Type, Gender, count(*) Group_Size
           from {Q.Split('gender').source('awards_cohort')} x group by all) g
          using (College, Major_Code, Award_Type, Gender)) y
        group by College, Major_Code, Award_Type, Course""")
add("student_award_term", _award_terms, "select * from program_award")
add("prior_flags", lambda s: S.prior_flags(s.cohort_profiles()),
    "select * from before_entry")
add("course_pivot_counts", _passes,
    "select Student_Id, Year_Semester, " + ", ".join(
        f"count(*) filter (Course='{c}') {name}" for c, name in zip(PATTERN, _PASS_NAMES))
    + f""" from passes semi join newcomers using (Student_Id) where Course in {Q.texts(PATTERN)}
       group by Student_Id, Year_Semester""")
add("current_term",
    lambda s: s.domain.terms.where((F.col("Year_Semester") == s.current) & (F.col("College") == "E")),
    f"""select * from terms where College='E' and Term_Start_Date <= DATE '{Q.AS_OF}'
        order by Year_Semester desc limit 1""")
add("distinct_values",
    lambda s: N.distinct_values(s.awards(D.STUDENT), ["Award_Type", "Academic_Year", "Gender"]),
    "select distinct Award_Type, Academic_Year, Gender from awards_all")
add("active_program_names", lambda s: D.active_program_names(s.domain, s.calendar),
    "select Major_Code, Major from active_majors")


def _share_sql(cells: str, within: str) -> str:
    share = f'"Count"/sum("Count") over (partition by {within})'
    return f"select *, {share} Proportion, {Q.percent(share)} Proportion_Label from ({cells}) c"


_GENDER = Q.Split("gender")
add("period_shares",
    lambda s: laurel.report_completers(s.completers(D.STUDENT), strata=SPLITS["gender"], fill=False),
    _share_sql(f"""select Award_Type, Academic_Year_Key, Academic_Year, Gender, count(*) "Count"
        from {_GENDER.source('awards_all')} x group by all""", "Award_Type, Academic_Year_Key"))
_COMPLETE = """(select * from {table} where Gender is not null and Ethnicity is not null and Cohort is not null
   and SGEC_Units is not null and Online_Units is not null and Year_Semester is not null
   and Academic_Year is not null and Terms_to_Complete is not null)"""
_COMPLETE_ALL = _COMPLETE.format(table="awards_all")


def _time_cells(split: Q.Split, source: str, extra: str = "") -> str:
    return f"""select {extra}Award_Type, {split.keys} Terms_to_Complete/4.0::double Time_to_Complete, count(*) "Count"
        from {split.source(source)} x group by all"""


add("time_shares", lambda s: laurel.report_time_to_award(s.completers(*D.DETAILS), SPLITS["gender"]),
    _share_sql(_time_cells(_GENDER, _COMPLETE_ALL), "Award_Type, Gender"))
add("change_shares",
    lambda s: X.COMPLETION_COHORT.with_label(V.change_shares(
        V.change_in_completers(s.spans, SPLITS["gender"]), SPLITS["gender"])),
    _share_sql(f"""select Award_Type, Gender, Completion_Cohort_Key, Completion_Cohort, count(*) "Count"
        from {_GENDER.source('rolling')} x group by all""", "Award_Type, Completion_Cohort_Key"))

# --- windows of the person-period table ---------------------------------------------------

add("previous_term",
    lambda s: s.table_rows().select("Student_Id", "Year_Semester",
                                    S.previous_term().alias("Previous_Year_Semester")),
    """select Student_Id, Year_Semester, coalesce((select max(e.Year_Semester) from later e
         where e.Student_Id=l.Student_Id and e.Year_Semester < l.Year_Semester), Cohort) Previous_Year_Semester
       from later l""")
_SO_FAR = "(partition by Student_Id order by Year_Semester range unbounded preceding)"
_RUNNING = ", ".join(f"cast(sum({source}) over {_SO_FAR} as bigint) {name}" for name, source in Q.TOTALS.items())
add("running_aid_terms",
    lambda s: s.table_rows().select("Student_Id", "Year_Semester", *S.running_aid_terms()),
    f"select Student_Id, Year_Semester, {_RUNNING} from later")
add("running_average_award",
    lambda s: rounded(s.table_rows().select("Student_Id", "Year_Semester",
                                            S.running_average_award().alias("Total_Award")), "Total_Award"),
    f"select Student_Id, Year_Semester, round(avg(Total_Award/4) over {_SO_FAR},6) Total_Award from later")
add("first_award_row",
    lambda s: S.first_award_row(_with_award(s)).select("Student_Id", "Year_Semester", "Earned_Award"),
    """select Student_Id, Year_Semester, Earned_Award from flagged
       where first_with_award is null or Year_Semester <= first_with_award""")

# --- sorts, set operations, gap filling ---------------------------------------------------

def _with_position(ordered: DataFrame, group: str) -> DataFrame:
    """Positions within a group, read off the order the frame itself has."""
    placed = ordered.withColumn("_place", F.monotonically_increasing_id())
    position = F.row_number().over(W.partitionBy(group).orderBy("_place"))
    return placed.withColumn("Position", position).drop("_place")


def _sort_by_period(s: Session) -> DataFrame:
    """The order as a column: positions of the sorted periods within their award type."""
    cells = X.AWARD_TERM.with_label(V.completers(s.awards(), X.AWARD_TERM))
    return _with_position(N.sort_by_period(cells, "Year_Semester_Key"), "Award_Type")


add("sort_by_period", _sort_by_period,
    """select Award_Type, Year_Semester_Key, Year_Semester, count(*) "Count", row_number() over
       (partition by Award_Type order by Year_Semester_Key) as Position from awards_all
       group by Award_Type, Year_Semester_Key, Year_Semester order by Award_Type, Year_Semester_Key""")
_TOP = f"""(select row_number() over (order by n desc, Course) as rank, Course from top_counts
   where Course not in {{excluded}} order by n desc, Course limit 25)"""
_DEFAULT_SPECIAL = ", ".join(f"'{c}'" for c in Q.SPECIAL_COURSES)


def _listed_sql(courses) -> str:
    return " union all ".join(
        f"select {26 + i} as rank, '{c}' as Course" for i, c in enumerate(courses))


add("top_program_courses",
    lambda s: laurel.top_program_courses(s.domain, s.calendar, Q.MAJOR, Q.AWARD),
    f"""select rank, Course from {_TOP.format(excluded=f'({_DEFAULT_SPECIAL})')} x
        union all {_listed_sql(Q.SPECIAL_COURSES)}""")
add("append_courses",
    lambda s: C.append_courses(C.top_courses(C.program_course_counts(
        s.domain, s.entry_cohorts(), s.current, "E", Q.MAJOR, Q.AWARD), 25, ["MATH 105"]), SPECIAL, 25),
    f"""select rank, Course from {_TOP.format(excluded="('MATH 105')")} x
        union all {_listed_sql(SPECIAL)}""")
add("sort_person_period",
    lambda s: _with_position(
        D.sort_person_period(s.table_rows().select("Student_Id", "Year_Semester", "Cohort")), "Student_Id"),
    """select Student_Id, Year_Semester, Cohort,
       count(*) over (partition by Student_Id order by Year_Semester) as Position from later""")
add("union_completer_groups",
    lambda s: counted(N.label_groups(s.groups()), "Group", "Award_Type", "Academic_Year"),
    """select 'All completers' "Group", Award_Type, Academic_Year, count(*) n from awards_all group by all
       union all
       select 'Six-year cohort' "Group", Award_Type, Academic_Year, count(*) n from awards_cohort group by all""")


def _generate_terms(s: Session) -> DataFrame:
    """All regular terms since the first course term, with the enrollments of each."""
    codes = T.term_range(F.lit(Q.FIRST_COURSE_TERM), F.lit(s.current - 1))
    listed = s.spark.range(1).select(F.explode(codes).alias("Year_Semester"))
    counts = N.count_cells(s.domain.enrollments, ["Year_Semester"], "n")
    return listed.join(counts, "Year_Semester", "left").withColumn("n", R.zero_if_missing(F.col("n")))


add("generate_terms", _generate_terms,
    """select num Year_Semester, coalesce(n,0) n from
       (select cast(unnest(generate_series(19741, (select t-1 from par))) as int) num) g
       left join (select Year_Semester, count(*) n from enrollments group by 1) e on num=Year_Semester
       where num%10 in (0,1,2,3)""")
add("fill_levels",
    lambda s: G.fill_levels(N.count_cells(s.rolling.where(
        F.col("Gender").isNotNull()), ["Award_Type", "Gender", "Term"]), _GRID, "Count"),
    f"""select g.*, coalesce(n,0) "Count" from (select * from {_GRID_SQL}) g left join
        (select Award_Type, Gender, Term, count(*) n from rolling group by all) r
        using (Award_Type, Gender, Term)""")


def _filled_sql(cells: str, dims: list[str], measures: dict[str, str], label: bool = True,
                within: str = "") -> str:
    """Grid of observed levels, left join, zeros. `dims` may be "key, label" pairs."""
    names = [n.strip() for d in dims for n in d.split(",")]
    on = " and ".join(f"g.{n} is not distinct from c.{n}" for n in
                      [*[w.strip() for w in within.split(",") if w.strip()], *names])
    first = f"(select distinct {within + ', ' if within else ''}{dims[0]} from cells) d0"
    grid = first + "".join(
        f" join (select distinct {within + ', ' if within else ''}{d} from cells) d{i} on "
        + (" and ".join(f"d0.{w.strip()}=d{i}.{w.strip()}" for w in within.split(",")) if within else "true")
        for i, d in enumerate(dims[1:], 1))
    chosen = [f"d0.{w.strip()}" for w in within.split(",") if w.strip()] + [
        f"d{i}.{n.strip()}" for i, d in enumerate(dims) for n in d.split(",")]
    values = ", ".join(f'coalesce(c."{m}", {zero}) "{m}"' for m, zero in measures.items())
    text = f", {Q.percent('coalesce(c.Proportion, 0.0)')} Proportion_Label" if label else ""
    return f"""with cells as ({cells}) select g.*, {values}{text}
        from (select {', '.join(chosen)} from {grid}) g left join cells c on {on}"""


_COUNT_SHARE = {"Count": "0", "Proportion": "0.0::double"}
_YEAR = "Academic_Year_Key, Academic_Year"
_TERM = "Year_Semester_Key, Year_Semester"
_COHORT = "Completion_Cohort_Key, Completion_Cohort"


def _plain_share(cells: str, within: str) -> str:
    return f'select *, "Count"/sum("Count") over (partition by {within}) Proportion from ({cells}) c'


def _completers_sql(split: Q.Split, period: str, groups: bool) -> str:
    key = period.split(",")[0]
    group = '"Group", ' if groups else ""
    if groups:
        source = split.source("(select *, 'All completers' \"Group\" from awards_all union all "
                              "select *, 'Six-year cohort' \"Group\" from awards_cohort)")
    else:
        source = split.source("awards_all")
    cells = f'select {group}Award_Type, {split.keys} {period}, count(*) "Count" from {source} x group by all'
    dims = ["Award_Type", *([split.column] if split.mode else []), period]
    return _filled_sql(_plain_share(cells, f"{group}Award_Type, {key}"), dims, _COUNT_SHARE,
                       within='"Group"' if groups else "")


add("fill_period", lambda s: laurel.report_completers(s.completers(), X.AWARD_TERM),
    _completers_sql(Q.Split(""), _TERM, False))
add("fill_period_stratum",
    lambda s: laurel.report_completers(s.completers(D.STUDENT), X.AWARD_TERM, SPLITS["ethnicity_gender"]),
    _completers_sql(Q.Split("ethnicity_gender"), _TERM, False))


def _wide(cells: DataFrame, s: Session, stratum: str, levels: list[str], period: X.Period) -> DataFrame:
    if period is X.ACADEMIC_YEAR:
        codes = T.academic_year_codes(s.calendar.academic_year_back(6), s.calendar.current_academic_year)
        return G.pivot_strata(cells, period.key, T.academic_year_label, codes, stratum, levels)
    codes = T.term_codes(s.calendar.award_cutoff(6), s.current)
    return G.pivot_strata(cells, period.key, T.term_label, codes, stratum, levels)


def _wide_sql(cells: str, stratum: str, levels: list[str], by_year: bool) -> str:
    if by_year:
        key, label = "Academic_Year", Q.year_label("y")
        series = "unnest(generate_series((select ay_cut from par), (select ay_now from par), 10001))"
    else:
        key, label = "Year_Semester", Q.term_label("y")
        series = "unnest(list_filter(range((select award_cut from par), (select t+1 from par)), lambda n: n%10 < 4))"
    columns = ", ".join(
        f"""coalesce(max("Count") filter ({stratum}='{g}'),0) "{g}",
        coalesce(max(Proportion) filter ({stratum}='{g}'),0.0::double) "{g} Proportion" """ for g in levels)
    shares = _plain_share(cells, f"Award_Type, {key}_Key")
    return f"""with cells as ({shares})
        select y {key}_Key, {label} {key}, a.Award_Type, {columns}
        from (select cast({series} as int) y) periods
        cross join (select distinct Award_Type from cells where {key}_Key is not null) a
        left join cells c on c.Award_Type=a.Award_Type and c.{key}_Key=y group by 1, 2, 3"""


_PAIRS = [f"{group} {gender}" for group in Q.ETHNICITIES for gender in Q.GENDERS]
_WIDE = {"": ("gender", Q.GENDERS, L.GENDERS), "_ethnicity": ("ethnicity", Q.ETHNICITIES, L.ETHNICITIES),
         "_ethnicity_gender": ("ethnicity_gender", _PAIRS, L.ETHNICITY_GENDERS)}
for by_year, period, ending in ((True, X.ACADEMIC_YEAR, ""), (False, X.AWARD_TERM, "_by_term")):
    key = "Academic_Year_Key" if by_year else "Year_Semester_Key"
    for name, (mode, values, levels) in _WIDE.items():
        split, strata = Q.Split(mode), SPLITS[mode]
        add(f"pivot_strata{name}{ending}",
            lambda s, strata=strata, split=split, levels=levels, period=period: _wide(
                laurel.report_completers(s.completers(D.STUDENT), period, strata, fill=False),
                s, split.column, levels, period),
            _wide_sql(f"""select Award_Type, {key}, {split.column}, count(*) "Count"
                from {split.source('awards_all')} x group by all""", split.column, values, by_year))
    for name, (column, article, yes) in _STATUS.items():
        report, levels = getattr(laurel, f"report_{name}"), [f"Not {article} student", yes]
        add(f"pivot_{name}{ending}",
            lambda s, report=report, column=column, levels=levels, period=period: _wide(
                report(s.completers(D.UNITS), STATUS_LIMIT, period, fill=False),
                s, f"{column}_Status", levels, period),
            _wide_sql(f"""select Award_Type, {key}, {column}_Status, count(*) "Count"
                from {_status_cells(name).replace('GROUPED', 'awards_all')} x group by all""",
                f"{column}_Status", levels, by_year))

# --- course mining -------------------------------------------------------------------------

add("course_baskets",
    lambda s: M.course_baskets(
        M.student_term_courses(s.domain, s.calendar, None, COLLEGES, 6),
        M.term_completion_ratio(s.domain.student_profiles),
    ).withColumn("Courses", F.array_join("Courses", ",")),
    """select Student_Id, Year_Semester, string_agg(Course, ',' order by Course) Courses, Completion
       from courses_raw group by Student_Id, Year_Semester, Completion""")


def _flat_rules(rules: DataFrame) -> DataFrame:
    return rounded(rules.withColumn("antecedent", F.array_join("antecedent", ",")).drop("baskets", "Set"),
                   "support", "confidence", "lift")


def _rules(lattice: DataFrame, name: str = M.ALL_BASKETS) -> DataFrame:
    return M.lattice_rules(lattice.where(F.col("Set") == name), Q.PATTERN_CONFIDENCE)


_RULE_COLUMNS = """array_to_string(ante, ',') antecedent, cons consequent, round(support,6) support,
   round(confidence,6) confidence, round(lift,6) lift"""
_SETS = {"all": "every", "success": "success", "failure": "failure"}
for name, prefix in _SETS.items():
    add(f"course_rules_{name}", lambda s, name=name: _flat_rules(_rules(s.lattice, name)),
        f"select {_RULE_COLUMNS} from {prefix}_rules")
add("discipline_rules", lambda s: _flat_rules(_rules(s.discipline_lattice)),
    f"select {_RULE_COLUMNS} from discipline_rules")
add("discipline_rules_pruned", lambda s: _flat_rules(M.prune_rules(_rules(s.discipline_lattice))),
    f"select {_RULE_COLUMNS} from discipline_pruned")
add("course_rules_pruned", lambda s: _flat_rules(M.prune_rules(_rules(s.lattice))),
    f"select {_RULE_COLUMNS} from every_pruned")


def _itemsets(select) -> Callable[[Session], DataFrame]:
    """The itemsets a function picks from the lattice, of all sets of baskets."""
    return lambda s: select(s.lattice).withColumn("items", F.array_join("items", ","))


_ITEMSETS = " union all ".join(
    f"select '{name}' as Set, items, c freq from {prefix}_frequent" for name, prefix in _SETS.items())


def _itemsets_sql(other: str) -> str:
    """Itemsets without another one of the same set, one item away, that is as frequent."""
    return f"""with sets as ({_ITEMSETS}) select Set, array_to_string(items, ',') items, freq from sets f
        where not exists (select 1 from sets g where g.Set=f.Set and g.freq=f.freq and {other})"""


add("frequent_itemsets", _itemsets(lambda edges: edges.select("Set", "items", "freq").distinct()),
    f"select Set, array_to_string(items, ',') items, freq from ({_ITEMSETS}) x")
add("closed_itemsets", _itemsets(M.closed_itemsets),
    _itemsets_sql("len(g.items)=len(f.items)+1 and list_has_all(g.items, f.items)"))
add("generator_itemsets", _itemsets(M.generators),
    _itemsets_sql("len(g.items)=len(f.items)-1 and list_has_all(f.items, g.items)")
    + f""" and not (len(items)=1 and freq=(select any_value(n) from
       ({' union all '.join(f"select '{name}' as Set, n from {prefix}_n" for name, prefix in _SETS.items())}) b
       where b.Set=f.Set))""")
_TABLE_COLUMNS = """'{' || array_to_string(ante, ',') || '} => {' || cons || '}' rules, round(support,6) support,
   round(confidence,6) confidence, round(lift,6) lift, count_both as count"""
add("rules_table", lambda s: rounded(M.rules_table(_rules(s.lattice)).drop("Set"), "support", "confidence", "lift"),
    f"select {_TABLE_COLUMNS} from every_rules")


def _course_patterns(s: Session) -> DataFrame:
    rules = laurel.course_rules(s.domain, s.calendar, confidence=Q.PATTERN_CONFIDENCE)
    return rounded(rules.withColumnRenamed("Set", "Pattern"), "support", "confidence", "lift")


add("course_patterns", _course_patterns, " union all ".join(
    f"select '{name}' as Pattern, {_TABLE_COLUMNS} from {prefix}_pruned"
    for name, prefix in _SETS.items()))


def _distribution_sql(split: Q.Split) -> str:
    program = "College, Major_Code, Award_Type"
    shares = f"""select {program}, {split.keys} Course, n "Count", Group_Size, n/Group_Size Proportion from
        (select {program}, {split.keys} Course, count(*) n from {split.source('takers')} x group by all) c left join
        (select {program}, {split.keys} count(*) Group_Size from {split.source('awards_cohort')} x group by all) g
        using ({program}{', ' + split.column if split.mode else ''})"""
    smallest = "and s.Group_Size >= 3" if split.mode else ""
    return f"""with shares as ({shares}), listed as (select {program}, Course from shares
        group by {program}, Course having count(*)=count(Proportion) and max(Proportion) > 0.25)
        select s.* from shares s join listed l on s.College=l.College and s.Major_Code=l.Major_Code
        and s.Award_Type=l.Award_Type and s.Course is not distinct from l.Course {smallest}"""


for mode in Q.MODES:
    split, strata = Q.Split(mode), SPLITS[mode]
    add(f"course_distribution{split.suffix}",
        lambda s, strata=strata: C.course_distribution(s.takers, s.cohort_students, strata=strata),
        _distribution_sql(split))


def _heatmap_sql(split: Q.Split) -> str:
    category = split.column if split.mode else "'All Students'"
    return f"select College, Major_Code, Award_Type, {category} as Category, Course, Proportion from ({_distribution_sql(split)}) h"


add("course_heatmap", lambda s: C.course_heatmap(C.course_distribution(s.takers, s.cohort_students)),
    _heatmap_sql(Q.Split("")))

# --- chart numbers --------------------------------------------------------------------------

def _histogram_sql(split: Q.Split) -> str:
    if not split.mode:
        return f"""select Award_Type, floor(x-0.5)+0.5 Bin_Start, floor(x-0.5)+1.5 Bin_End, count(*) "Count"
            from (select Award_Type, Terms_to_Complete/4.0::double x from {_COMPLETE_ALL} c) y group by all"""
    return f"""select Award_Type, {split.keys} (ceil(x/w-0.5)-0.5)*w Bin_Start, (ceil(x/w-0.5)-0.5)*w+w Bin_End,
        count(*) "Count" from (select *, case when max(x) over (partition by Award_Type) > 10 then 1.0::double
          else 0.5::double end w from (select *, Terms_to_Complete/4.0::double x from {split.source(_COMPLETE_ALL)} c) z) y
        group by all"""


def _density_sql(split: Q.Split, scale: str = "Terms_to_Complete::double") -> str:
    keys = f"Award_Type{', ' + split.column if split.mode else ''}"
    return f"""with v as (select {keys}, {scale} x from {split.source(_COMPLETE_ALL)} z),
        r as (select Award_Type, min(x) lo, max(x) hi from v group by Award_Type),
        b as (select {keys}, count(*) n, stddev_samp(x) sd, (quantile_cont(x,0.75)-quantile_cont(x,0.25))/1.34 iq,
              max(abs(x)) size from v group by {keys} having count(*) > 1),
        w as (select *, 0.9*(case when least(sd,iq) > 0 then least(sd,iq) when sd > 0 then sd when size > 0 then size else 1 end)*pow(n,-0.2) bw
              from b),
        k as (select {keys}, x, count(*) c from v group by all)
        select {', '.join('w.' + c.strip() for c in keys.split(','))}, p.i "Point", round(lo+p.i*((hi-lo)/511),6) X,
          round(bw,6) Bandwidth, round(sum(c*exp(-0.5*pow((lo+p.i*((hi-lo)/511)-x)/bw,2)))/(n*bw*sqrt(2*pi())),6) Density
        from w join r on w.Award_Type=r.Award_Type
        join k on {' and '.join(f'w.{c.strip()}=k.{c.strip()}' for c in keys.split(','))}
        cross join (select cast(unnest(generate_series(0,511)) as int) i) p
        group by all_keys""".replace(
        "group by all_keys",
        "group by " + ", ".join("w." + c.strip() for c in keys.split(",")) + ", p.i, lo, hi, bw, n")


for mode, name in (("", ""), ("gender", "_stratified"), ("ethnicity", "_ethnicity"),
                   ("ethnicity_gender", "_ethnicity_gender")):
    split, strata = Q.Split(mode), SPLITS[mode]
    add(f"time_histogram{name}", lambda s, strata=strata: laurel.time_histogram(s.awards_all, strata),
        _histogram_sql(split))
    add(f"time_density{name}",
        lambda s, strata=strata: rounded(laurel.time_density(s.awards_all, strata),
                                         "X", "Bandwidth", "Density"),
        _density_sql(split))

add("time_density_years",
    lambda s: rounded(laurel.time_density(s.awards_all, unit="years"), "X", "Bandwidth", "Density"),
    _density_sql(Q.Split(""), "Terms_to_Complete/4.0::double"))

_ROUNDED_EFFICIENCY = """select College, Major_Code, Award_Type, Completion_Cohort_Key, Completion_Cohort, Completers,
   round(FTES,2) FTES, round(FTEF,2) FTEF, round(Efficiency,2) Efficiency from efficiency"""
add("efficiency_series",
    lambda s: rounded(laurel.efficiency_series(s.efficiency), "FTES", "FTEF", "Efficiency"),
    _filled_sql(_ROUNDED_EFFICIENCY, ["Award_Type", _COHORT],
                {"Completers": "0", "FTES": "0.0::double", "FTEF": "0.0::double", "Efficiency": "0.0::double"},
                label=False, within="College, Major_Code"))

# --- data sets and reports -------------------------------------------------------------------

_DATASET = """College, Major_Code, Award_Type, Year_Semester_Key, Year_Semester, Gender, Ethnicity, Cohort,
   SGEC_Units, Online_Units, Academic_Year_Key, Academic_Year, Terms_to_Complete"""
add("awards_all", lambda s: s.awards_all, f"select {_DATASET} from awards_all")
add("awards_cohort", lambda s: s.awards_cohort, f"select {_DATASET} from awards_cohort")
add("rolling_cohorts", lambda s: s.rolling, "select * from rolling")
add("course_takers", lambda s: s.takers, "select * from takers")


_SURVIVAL = f"""select l.Student_Id, {Q.between('l.Year_Semester', 'Cohort')} Year_Semester,
    {Q.between('Previous', 'Cohort')} Previous_Year_Semester, Cohort, Term_Age-18 Term_Age,
    {', '.join(f'coalesce(cast({test} as int), 0) {name}' for name, test in Q.FLAGS.items())}, Military, DSPS,
    {', '.join(f'total_{name} {name}' for name in Q.TOTALS)}, average Total_Award, Declared_Major_at_Entry,
    round(District_Cumulative_GPA-2,6) GPA, coalesce(Former_Concurrent_Student,0) Former_Concurrent_Student,
    coalesce(Former_PSA_Student,0) Former_PSA_Student, Foster_Youth, Earned_Award, Any_Hispanic, Any_Asian,
    {_PASSES_SO_FAR}
  from (select *, coalesce(lag(Year_Semester) over by_term, Cohort) Previous,
          round(avg(Total_Award/4) over by_term,6) average,
          {', '.join(f'cast(sum({source}) over by_term as bigint) total_{name}' for name, source in Q.TOTALS.items())}
        from flagged window by_term as (partition by Student_Id order by Year_Semester)) l
  left join students using (Student_Id) left join ethnicity_details using (Student_Id)
  left join before_entry using (Student_Id) left join at_entry using (Student_Id)
  where first_with_award is null or l.Year_Semester <= first_with_award"""
add("survival_person_period",
    lambda s: rounded(laurel.survival_person_period(
        s.domain, s.calendar, Q.MAJOR, Q.AWARD, PATTERN, first_course_term=Q.FIRST_COURSE_TERM),
        "Total_Award", "GPA"),
    _SURVIVAL)

_TIME_GROUPS = (f"(select *, 'All completers' \"Group\" from {_COMPLETE_ALL} a union all "
                f"select *, 'Six-year cohort' \"Group\" from {_COMPLETE.format(table='awards_cohort')} b)")
for mode in Q.MODES:
    split, strata = Q.Split(mode), SPLITS[mode]
    add(f"report_completers{split.suffix}",
        lambda s, strata=strata: laurel.report_completers(s.groups(*parts(strata)), strata=strata),
        _completers_sql(split, _YEAR, True))
    add(f"report_completers_by_term{split.suffix}",
        lambda s, strata=strata: laurel.report_completers(s.groups(*parts(strata)), X.AWARD_TERM, strata),
        _completers_sql(split, _TERM, True))
    add(f"report_time_to_award{split.suffix}",
        lambda s, strata=strata: laurel.report_time_to_award(s.groups(*D.DETAILS), strata),
        _share_sql(_time_cells(split, _TIME_GROUPS, '"Group", '),
                   f'"Group", Award_Type{", " + split.column if split.mode else ""}'))
    cells = f"""select Award_Type, {split.keys} {_COHORT}, count(*) "Count" from {split.source('rolling')} x group by all"""
    add(f"report_change_completers{split.suffix}",
        lambda s, strata=strata: laurel.report_change_completers(s.spans, strata),
        _filled_sql(_plain_share(cells, "Award_Type, Completion_Cohort_Key"),
                    ["Award_Type", split.column, _COHORT], _COUNT_SHARE) if split.mode else
        f"select *, 1.0::double Proportion, '100.0 %' Proportion_Label from ({cells}) c")
    add(f"report_course_taking{split.suffix}",
        lambda s, strata=strata: laurel.report_course_taking(s.takers, s.cohort_students, strata=strata),
        _heatmap_sql(split))

for name, (column, *_rest) in _STATUS.items():
    report = getattr(laurel, f"report_{name}")
    source = _status_cells(name).replace(
        "GROUPED", "(select *, 'All completers' \"Group\" from awards_all union all "
                   "select *, 'Six-year cohort' \"Group\" from awards_cohort) u")
    for ending, period, names in (("", X.ACADEMIC_YEAR, _YEAR), ("_by_term", X.AWARD_TERM, _TERM)):
        cells = f"""select "Group", Award_Type, {column}_Status, {names}, count(*) "Count" from {source} x group by all"""
        add(f"report_{name}{ending}",
            lambda s, report=report, period=period: report(s.groups(D.UNITS), STATUS_LIMIT, period),
            _filled_sql(_plain_share(cells, f'"Group", Award_Type, {names.split(",")[0]}'),
                        ["Award_Type", f"{column}_Status", names], _COUNT_SHARE, within='"Group"'))

add("report_change_efficiency", lambda s: laurel.report_change_efficiency(s.efficiency),
    """select Completion_Cohort_Key, Completion_Cohort, Award_Type, Completers, round(FTES,2) FTES,
       round(FTEF,2) FTEF, round(Efficiency,2) Efficiency from efficiency""")
add("report_change_time",
    lambda s: laurel.report_change_time(s.spans, seasons=["Fall", "Spring"]),
    f"""select Award_Type, {_COHORT}, count(*) Group_Size, median(Terms_to_Complete/4.0::double) Median_Years,
        (select median(Terms_to_Complete/4.0::double) from rolling where Term in ('Fall','Spring')) Median_Years_Overall
        from rolling where Term in ('Fall','Spring') group by Award_Type, {_COHORT}""")

# --- reports with a user's selections ---------------------------------------------------------

CHOSEN_AWARDS = ["Associate in Arts", "Certificate of Achievement"]
CHOSEN_SEASONS = ["Fall", "Spring"]
CHOSEN_GROUPS = ["Asian", "White"]
_CHOSEN = f"Award_Type in {Q.texts(CHOSEN_AWARDS)}"
_SEASONS = f"Term in {Q.texts(CHOSEN_SEASONS)}"
_FEW = X.Strata(ethnicities=tuple(CHOSEN_GROUPS))
_FEW_SQL = Q.Split("ethnicity")
_FEW_SQL.where = f"Ethnicity in {Q.texts(CHOSEN_GROUPS)}"


def _only(table: str, condition: str) -> str:
    return f"(select * from {table} where {condition})"


add("report_completers_selected",
    lambda s: laurel.report_completers(s.completers(D.STUDENT), strata=_FEW, award_types=CHOSEN_AWARDS),
    _filled_sql(_plain_share(f"""select Award_Type, Ethnicity, {_YEAR}, count(*) "Count"
        from {_FEW_SQL.source(_only('awards_all', _CHOSEN))} x group by all""", "Award_Type, Academic_Year_Key"),
        ["Award_Type", "Ethnicity", _YEAR], _COUNT_SHARE))
add("report_time_to_award_selected",
    lambda s: laurel.report_time_to_award(s.completers(*D.DETAILS), _FEW, CHOSEN_AWARDS),
    _share_sql(_time_cells(_FEW_SQL, _only(_COMPLETE_ALL + " a", _CHOSEN)), "Award_Type, Ethnicity"))
add("report_sgec_selected",
    lambda s: laurel.report_sgec(s.completers(D.UNITS), STATUS_LIMIT, award_types=CHOSEN_AWARDS),
    _filled_sql(_plain_share(f"""select Award_Type, SGEC_Status, {_YEAR}, count(*) "Count"
        from {_status_cells('sgec').replace('GROUPED', _only('awards_all', _CHOSEN) + ' a')} x group by all""",
        "Award_Type, Academic_Year_Key"), ["Award_Type", "SGEC_Status", _YEAR], _COUNT_SHARE))
add("report_online_selected",
    lambda s: laurel.report_online(s.completers(D.UNITS), STATUS_LIMIT, award_types=CHOSEN_AWARDS),
    _filled_sql(_plain_share(f"""select Award_Type, Online_Status, {_YEAR}, count(*) "Count"
        from {_status_cells('online').replace('GROUPED', _only('awards_all', _CHOSEN) + ' a')} x group by all""",
        "Award_Type, Academic_Year_Key"), ["Award_Type", "Online_Status", _YEAR], _COUNT_SHARE))
add("report_change_completers_selected",
    lambda s: laurel.report_change_completers(s.spans, _FEW, CHOSEN_AWARDS, CHOSEN_SEASONS),
    _filled_sql(_plain_share(f"""select Award_Type, Ethnicity, {_COHORT}, count(*) "Count"
        from {_FEW_SQL.source(_only('rolling', f'{_CHOSEN} and {_SEASONS}'))} x group by all""",
        "Award_Type, Completion_Cohort_Key"), ["Award_Type", "Ethnicity", _COHORT], _COUNT_SHARE))
add("report_change_efficiency_selected",
    lambda s: laurel.report_change_efficiency(s.efficiency, CHOSEN_AWARDS, CHOSEN_SEASONS),
    f"""select {_COHORT}, Award_Type, Completers, round(FTES,2) FTES, round(FTEF,2) FTEF,
        round(Efficiency,2) Efficiency from efficiency where {_CHOSEN} and {_SEASONS}""")
add("report_change_time_selected",
    lambda s: laurel.report_change_time(s.spans, _FEW, CHOSEN_AWARDS, CHOSEN_SEASONS),
    f"""select Award_Type, Ethnicity, {_COHORT}, count(*) Group_Size, median(Terms_to_Complete/4.0::double) Median_Years
        from {_FEW_SQL.source(_only('rolling', f'{_CHOSEN} and {_SEASONS}'))} x
        group by Award_Type, Ethnicity, {_COHORT}""")
add("report_course_taking_selected",
    lambda s: laurel.report_course_taking(s.takers, s.cohort_students, CHOSEN_AWARDS, _FEW),
    f"select * from ({_heatmap_sql(_FEW_SQL)}) x where {_CHOSEN}")

# --- all split modes at once, and people ------------------------------------------------------

def _modes_sql(table: str, fixed: str, measure: str, either: tuple[str, ...] = ("",)) -> str:
    """The modes as grouping sets, with the stratum as Category."""
    sets = ", ".join(
        f"({', '.join(c for c in (fixed, *split, part) if c)})"
        for split in ((), ("Gender",), ("Ethnicity",), ("Gender", "Ethnicity")) for part in either)
    others = "".join(f", {c}, grouping({c.split(',')[0]}) without_{i}" for i, c in enumerate(either) if c)
    return f"""(select case gg*2+ge when 0 then 'ethnicity_gender' when 1 then 'gender' when 2 then 'ethnicity' else 'none' end "Mode",
          case gg*2+ge when 0 then Ethnicity || ' ' || Gender when 1 then Gender when 2 then Ethnicity else 'All Students' end Category, *
        from (select {fixed}, Gender, Ethnicity{others}, grouping(Gender) gg, grouping(Ethnicity) ge, {measure}
              from {table} group by grouping sets ({sets})) x
        where (gg=1 or Gender is not null) and (ge=1 or Ethnicity is not null))"""


add("report_completers_modes", lambda s: laurel.report_completers_modes(s.awards(D.STUDENT)),
    _share_sql(f"""select "Mode", Category, Award_Type, case when without_0=0 then 'academic_year' else 'term' end "Scale",
        case when without_0=0 then Academic_Year_Key else Year_Semester_Key end Period_Key,
        case when without_0=0 then Academic_Year else Year_Semester end "Period", n "Count"
        from {_modes_sql('awards_all', 'Award_Type', 'count(*) n', (_YEAR, _TERM))} m""",
        '"Mode", "Scale", Award_Type, Period_Key'))
add("report_change_completers_modes", lambda s: laurel.report_change_completers_modes(s.spans),
    _share_sql(f"""select "Mode", Category, Award_Type, {_COHORT}, n "Count"
        from {_modes_sql('rolling', f'Award_Type, {_COHORT}', 'count(*) n')} m""",
        '"Mode", Award_Type, Completion_Cohort_Key'))
_PROGRAM = "College, Major_Code, Award_Type"
add("report_course_taking_modes", lambda s: laurel.report_course_taking_modes(s.takers, s.cohort_students),
    f"""with counts as {_modes_sql('takers', f'{_PROGRAM}, Course', 'count(*) n')},
        sizes as {_modes_sql('awards_cohort', _PROGRAM, 'count(*) Group_Size')},
        shares as (select c."Mode", c.Category, c.College, c.Major_Code, c.Award_Type, Course, Group_Size,
            n/Group_Size Proportion from counts c left join sizes g on c."Mode"=g."Mode" and c.Category=g.Category
            and c.College=g.College and c.Major_Code=g.Major_Code and c.Award_Type=g.Award_Type)
        select "Mode", {_PROGRAM}, Category, Course, Proportion from
          (select *, max(Proportion) over part largest, count(*) over part = count(Proportion) over part complete
           from shares window part as (partition by "Mode", {_PROGRAM}, Course)) x
        where largest > 0.25 and complete and ("Mode"='none' or Group_Size >= 3)""")


def _people_sql() -> str:
    parts = []
    for award in ("Award_Type", "'Any award'"):
        for key, label in (("Academic_Year_Key", "Academic_Year"), ("0", "'All years'")):
            rows = f"""(select Student_Id, Gender, Ethnicity, {award} as Award, {key} as Year_Key, {label} as Year_Label
                from people_all where Academic_Year_Key is not null) p"""
            parts.append(f"""select "Mode", Category, Award as Award_Type, Year_Key Academic_Year_Key,
                Year_Label Academic_Year, People
                from {_modes_sql(rows, 'Award, Year_Key, Year_Label', 'count(distinct Student_Id) People')} m""")
    return " union all ".join(parts)


add("distinct_completers",
    lambda s: laurel.distinct_completers(s.awards(D.STUDENT, D.PERSON), s.numbers), _people_sql())
add("change_in_people",
    lambda s: laurel.change_in_people(D.rolling_spans(s.domain, s.calendar, person=True)),
    f"""select "Mode", Category, Award_Type, {_COHORT}, People
        from {_modes_sql('people_rolling', f'Award_Type, {_COHORT}', 'count(distinct Student_Id) People')} m""")

# --- chosen majors, two colleges, other limits and ends ----------------------------------------

CHOSEN_MAJORS = ["000100", "000300"]
_MAJORS = f"Major_Code in {Q.texts(CHOSEN_MAJORS)}"
_BOTH = {name: text.replace("in ('E')", "in ('E', 'W')") for name, text in Q.PARTS.items() if "in ('E')" in text}
BOTH_COLLEGES = ("E", "W")


def _built(build, *columns: str, **options) -> Callable[[Session], DataFrame]:
    return lambda s: rounded(build(s.domain, s.calendar, **options), *columns)


_EFFICIENCY = """select * replace (round(FTES,6) as FTES, round(FTEF,6) as FTEF, round(Efficiency,6) as Efficiency)
   from efficiency"""
_EFFORT = ("FTES", "FTEF", "Efficiency")
add("awards_all_majors", _built(laurel.awards_all, majors=CHOSEN_MAJORS),
    f"select {_DATASET} from awards_all where {_MAJORS}")
add("efficiency_majors", _built(laurel.efficiency, *_EFFORT, majors=CHOSEN_MAJORS),
    f"{_EFFICIENCY} where {_MAJORS}")
add("course_takers_majors", _built(laurel.course_takers, majors=CHOSEN_MAJORS), f"select * from takers where {_MAJORS}")
add("report_sgec_majors",
    lambda s: laurel.report_sgec(laurel.award_groups(s.domain, s.calendar, CHOSEN_MAJORS, details=(D.UNITS,)), STATUS_LIMIT),
    _filled_sql(_plain_share(f"""select "Group", Award_Type, SGEC_Status, {_YEAR}, count(*) "Count"
        from {_status_cells('sgec').replace('GROUPED', f"""(select *, 'All completers' "Group" from awards_all union all
          select *, 'Six-year cohort' "Group" from awards_cohort) u""")} x where {_MAJORS} group by all""",
        '"Group", Award_Type, Academic_Year_Key'), ["Award_Type", "SGEC_Status", _YEAR], _COUNT_SHARE, within='"Group"'))
add("efficiency_colleges", _built(laurel.efficiency, *_EFFORT, colleges=BOTH_COLLEGES), _EFFICIENCY, **_BOTH)
add("rolling_cohorts_colleges", _built(laurel.rolling_cohorts, colleges=BOTH_COLLEGES), "select * from rolling", **_BOTH)
add("report_change_completers_colleges",
    lambda s: laurel.report_change_completers(D.rolling_spans(s.domain, s.calendar, colleges=BOTH_COLLEGES)),
    f"""select *, 1.0::double Proportion, '100.0 %' Proportion_Label from
        (select Award_Type, {_COHORT}, count(*) "Count" from rolling group by all) c""", **_BOTH)
add("course_patterns_colleges",
    lambda s: rounded(laurel.course_rules(s.domain, s.calendar, CHOSEN_MAJORS, BOTH_COLLEGES, confidence=Q.PATTERN_CONFIDENCE)
                      .withColumnRenamed("Set", "Pattern"), "support", "confidence", "lift"),
    " union all ".join(f"select '{name}' as Pattern, {_TABLE_COLUMNS} from {prefix}_pruned" for name, prefix in _SETS.items()),
    **_BOTH, finishers=_BOTH.get("finishers", Q.PARTS["finishers"]) + f" and {_MAJORS}")
COHORT_END = 20001
_UNTIL = {"par": Q.PARTS["par"].replace("select arg_max(Year_Semester, Year_Semester) t", f"select {COHORT_END} t, count(*) n")}
add("top_program_courses_until",
    lambda s: laurel.top_program_courses(s.domain, s.calendar, Q.MAJOR, Q.AWARD, cohort_end=COHORT_END),
    f"""select rank, Course from {_TOP.format(excluded=f'({_DEFAULT_SPECIAL})')} x
        union all {_listed_sql(Q.SPECIAL_COURSES)}""", **_UNTIL)
add("survival_person_period_until",
    lambda s: rounded(laurel.survival_person_period(
        s.domain, s.calendar, Q.MAJOR, Q.AWARD, PATTERN, first_course_term=Q.FIRST_COURSE_TERM, cohort_end=COHORT_END),
        "Total_Award", "GPA"),
    _SURVIVAL, **_UNTIL)
LOW_LIMIT = 35
for name, (column, *_rest) in _STATUS.items():
    report = getattr(laurel, f"report_{name}")
    add(f"report_{name}_low_limit",
        lambda s, report=report: report(s.completers(D.UNITS), LOW_LIMIT),
        _filled_sql(_plain_share(f"""select Award_Type, {column}_Status, {_YEAR}, count(*) "Count"
            from {_status_cells(name).replace('GROUPED', 'awards_all').replace(f'>= {STATUS_LIMIT}', f'>= {LOW_LIMIT}')} x
            group by all""", "Award_Type, Academic_Year_Key"), ["Award_Type", f"{column}_Status", _YEAR], _COUNT_SHARE))


def _refreshed(s: Session, period: X.Period, strata: X.Strata) -> DataFrame:
    """Stored as of an earlier term and without late rows, then refreshed with what has arrived since."""
    before = s.current - 10
    known = (F.col("Award_Date") < F.lit(dt.date(before // 10, 6, 10))) & (F.col("Student_Id") % 97 != 0)
    earlier = laurel.Domain.from_frames(s.spark, **{
        name: s.domain[name].where(known) if name == "awards" else s.domain[name] for name in laurel.SCHEMAS})
    store = laurel.CompleterStore(s.spark, f"{shared_folder(s.spark)}/completers-{uuid.uuid4().hex}")
    store.build(earlier, laurel.Calendar.load(earlier, dt.date(before // 10, 9, 1)))
    store.refresh(s.domain, s.calendar, s.domain.awards.where(~known), before)
    return store.report(s.calendar, period, strata)


def _corrected(s: Session, period: X.Period, strata: X.Strata) -> DataFrame:
    """Stored with wrong dates for some awards and with awards that were never made, then put right."""
    awards = s.domain["awards"]
    wrong = awards.where(F.col("Student_Id") % 97 == 0).withColumn("Award_Date", F.date_sub("Award_Date", 200))
    untrue = awards.where(F.col("Student_Id") % 89 == 0).withColumn("Award_Date", F.date_add("Award_Date", 1000))
    mended = awards.where(F.col("Student_Id") % 97 == 0)
    stored = awards.where(F.col("Student_Id") % 97 != 0).unionByName(wrong).unionByName(untrue)
    earlier = laurel.Domain.from_frames(s.spark, **{
        name: stored if name == "awards" else s.domain[name] for name in laurel.SCHEMAS})
    store = laurel.CompleterStore(s.spark, f"{shared_folder(s.spark)}/completers-{uuid.uuid4().hex}")
    store.build(earlier, s.calendar)
    store.refresh(s.domain, s.calendar, wrong.unionByName(untrue).unionByName(mended), s.calendar.current_term)
    return store.report(s.calendar, period, strata)


add("report_completers_refreshed", lambda s: _refreshed(s, X.ACADEMIC_YEAR, X.UNSPLIT),
    _completers_sql(Q.Split(""), _YEAR, False))
add("report_completers_refreshed_by_term", lambda s: _refreshed(s, X.AWARD_TERM, SPLITS["gender"]),
    _completers_sql(Q.Split("gender"), _TERM, False))
add("report_completers_corrected", lambda s: _corrected(s, X.ACADEMIC_YEAR, X.UNSPLIT),
    _completers_sql(Q.Split(""), _YEAR, False))
add("report_completers_corrected_by_term", lambda s: _corrected(s, X.AWARD_TERM, SPLITS["gender"]),
    _completers_sql(Q.Split("gender"), _TERM, False))
