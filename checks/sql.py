"""Building blocks of the comparison SQL: named sub-queries and expression helpers.

Written from the rules, with what DuckDB offers and Spark does not: as-of joins, lists of
completion cohorts built per row, correlated counts. Each name is one notion: `dated_awards`
are awards with the term they fall in, `entrants` are the students who entered a college,
`counted` are award rows of active programs, and so on.
"""

from __future__ import annotations

import re

AS_OF = "2001-09-01"
MAJOR, AWARD = "000100", "AA"
PATTERN_CONFIDENCE = 0.01
FIRST_COURSE_TERM = 19741

# Fixed values, written out here and not taken from the library that is checked.
AWARD_NAMES = {
    "CS": "Skills Certificate", "C": "Certificate of Achievement", "AA": "Associate in Arts",
    "AS": "Associate in Science", "AT": "Associate in Arts for Transfer",
    "ST": "Associate in Science for Transfer", "CN": "Noncredit Certificate",
}
UNKNOWN_AWARD = "Unknown award type"
GENDERS = ["Male", "Female"]
ETHNICITIES = [
    "Asian", "Black/African American", "Hawaiian/Pacific Islander", "Hispanic/Latino",
    "Native American", "Two or more races", "Unknown", "White",
]
SEASONS = ["Summer", "Fall", "Winter", "Spring"]
SPECIAL_COURSES = [
    "MATH 105", "MATH 110", "MATH 112", "MATH 115", "MATH 125", "ENGLISH 019", "ENGLISH 021",
    "ENGLISH 026", "ENGLISH 028", "READING 019", "READING 020",
]
FLAGS = {
    "Transfer_Goal": "Education_Goal = 'Transfer'",
    "Undecided_Goal": "Education_Goal = 'Undecided'",
    "CSU_UC_Student": "Education_Goal = 'UC/CSU Student'",
    "Degree_Goal": "Education_Goal = 'Associate''s Degree'",
    "Career_Goal": "Education_Goal = 'Career/Job Advancement'",
    "AB_540_Student": "Residency_Status = 'AB 540'",
    "California_Resident": "Residency_Status = 'California Resident'",
    "International_Student": "Residency_Status = 'International'",
    "Female": "Gender = 'F'",
    "Spanish_Speaking": "Language = 'Spanish'",
    "Chinese_Speaking": "Language = 'Chinese'",
    "Vietnamese_Speaking": "Language = 'Vietnamese'",
}
TOTALS = {
    "EOPS": "EOPS", "CalWorks": "CalWorks", "BOGG": "BOGG", "Units_Completed": "Units_Completed",
    "Online_Only_Terms": "Online_Only", "SGEC_Only_Terms": "SGEC_Only",
}


def texts(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def season(x: str) -> str:
    return (f"(case when {x} is null then null when {x}%10=0 then 'Winter' when {x}%10=1 then 'Spring' "
            f"when {x}%10=2 then 'Summer' else 'Fall' end)")


def term_label(x: str) -> str:
    return f"({season(x)} || ' ' || cast({x}//10 as varchar))"


def academic_year(x: str) -> str:
    return (f"cast(case when {x}%10 in (2,3) then ({x}//10)*10000+({x}//10)+1 "
            f"else (({x}//10)-1)*10000+({x}//10) end as int)")


def year_label(y: str) -> str:
    return f"(substr(cast({y} as varchar),1,4) || '-' || substr(cast({y} as varchar),7,2))"


def between(a: str, b: str) -> str:
    return f"cast((({a}//10)-({b}//10))*4 + ({a}%10)-({b}%10) as int)"


def award_name(x: str) -> str:
    cases = " ".join(f"when {x}='{k}' then '{v}'" for k, v in AWARD_NAMES.items())
    return f"(case {cases} else 'Unknown award type' end)"


def gender(x: str) -> str:
    return f"(case when {x} is null then null when {x}='M' then 'Male' else 'Female' end)"


def ethnicity(x: str) -> str:
    return f"(case when {x} in {texts(ETHNICITIES)} then {x} end)"


def percent(p: str) -> str:
    """Half-up on the decimal value, as the label is defined."""
    return (f"(printf('%.1f', cast(round(cast({p} as decimal(18,9)),3)*100 as double)) || ' %')")


class Split:
    """SQL of a split mode: output column, its expression and the row filter."""

    def __init__(self, mode: str):
        self.mode = mode
        genders, groups = f"Gender in {texts(GENDERS)}", f"Ethnicity in {texts(ETHNICITIES)}"
        self.column, self.expr, self.where = {
            "": ("", "", "true"),
            "gender": ("Gender", "Gender", genders),
            "ethnicity": ("Ethnicity", "Ethnicity", groups),
            "ethnicity_gender": ("Ethnicity_Gender", "Ethnicity || ' ' || Gender",
                                 f"{genders} and {groups}"),
        }[mode]
        self.suffix = f"_{mode}" if mode else ""
        self.select = f"{self.expr} as {self.column}, " if mode else ""
        self.keys = f"{self.column}, " if mode else ""

    def source(self, table: str) -> str:
        return f"(select {'*' if self.mode != 'ethnicity_gender' else '*, ' + self.expr + ' as Ethnicity_Gender'} from {table} where {self.where})"


MODES = ["", "gender", "ethnicity", "ethnicity_gender"]

PARTS: dict[str, str] = {}

# Domain tables (fixture description).
PARTS["terms"] = "select cast(y*10+s as int) Year_Semester, 'E' College, case s when 0 then make_date(y,1,1) when 1 then make_date(y,2,5) when 2 then make_date(y,6,10) else make_date(y,8,25) end Term_Start_Date from (select distinct cast(year(l_shipdate) as int) y from lineitem) a cross join (values (0),(1),(2),(3)) as b(s)"
PARTS["students"] = "select c_custkey Student_Id, case when c_custkey%53=0 then null when c_custkey%5<2 then 'M' when c_custkey%5<4 then 'F' else 'X' end Gender, case when c_nationkey=24 then 'Other' when c_nationkey=23 then null when c_nationkey%8=0 then 'Asian' when c_nationkey%8=1 then 'Black/African American' when c_nationkey%8=2 then 'Hawaiian/Pacific Islander' when c_nationkey%8=3 then 'Hispanic/Latino' when c_nationkey%8=4 then 'Native American' when c_nationkey%8=5 then 'Two or more races' when c_nationkey%8=6 then 'Unknown' else 'White' end Ethnicity, case when c_custkey%6=0 then 'Spanish' when c_custkey%6=1 then 'Chinese' when c_custkey%6=2 then 'Vietnamese' else 'English' end Language, case when c_custkey%31=0 then 1 else 0 end Foster_Youth from customer"
PARTS["cohorts"] = "select c_custkey Student_Id, cast((1993+c_custkey%7)*10+cast(floor(c_custkey/7) as bigint)%4 as int) Cohort, case when c_custkey%10=0 then 'W' else 'E' end Cohort_College from customer where c_custkey%29<>0"
PARTS["awards"] = "select o_custkey Student_Id, case when o_orderkey%10<8 then 'E' else 'W' end College, lpad(cast((o_orderkey%6+1)*100 as varchar(10)),6,'0') Major_Code, case when o_orderkey%41=0 then 'ZZ' when o_orderpriority='1-URGENT' then 'CS' when o_orderpriority='2-HIGH' then 'C' when o_orderpriority='3-MEDIUM' then 'AA' when o_orderpriority='4-NOT SPECIFIED' then 'AS' else 'AT' end Award_Type, cast(o_orderdate as date) Award_Date, cast(case when month(o_orderdate)>=7 then year(o_orderdate)*10000+year(o_orderdate)+1 else (year(o_orderdate)-1)*10000+year(o_orderdate) end as int) Catalog_Year from orders where o_orderstatus='F'"
PARTS["programs"] = "select a.College, a.Major_Code, concat('Program ',a.Major_Code,' rev ',cast(a.Catalog_Year%10 as varchar(4))) Major, a.Award_Type, a.Catalog_Year, cast(case when a.Award_Type='AT' and a.Major_Code='000600' and a.Catalog_Year<19981999 then 19983 end as int) Final_Term from (select distinct College, Major_Code, Award_Type, Catalog_Year from awards) a"
PARTS["enrollments"] = "select o_custkey Student_Id, case when l_suppkey%5=0 then 'W' else 'E' end College, cast(year(l_shipdate)*10 + case when month(l_shipdate)*100+day(l_shipdate)<205 then 0 when month(l_shipdate)*100+day(l_shipdate)<610 then 1 when month(l_shipdate)*100+day(l_shipdate)<825 then 2 else 3 end as int) Year_Semester, l_partkey Section_Number, case when l_returnflag='A' and l_linestatus='F' then 'A' when l_returnflag='A' then 'B' when l_returnflag='N' and l_linestatus='F' then 'C' when l_returnflag='N' then 'P' when l_linestatus='F' then 'F' else 'E' end Grade, cast(1+cast(l_quantity as int)%5 as int) Units, l_linenumber Line from lineitem join orders on l_orderkey=o_orderkey"
PARTS["sections2"] = "select e.Section_Number, e.College, e.Year_Semester, upper(split_part(p_name,' ',2)) Discipline, concat(upper(split_part(p_name,' ',2)),' ',cast(100+p_size%10 as varchar(4))) Course, case when p_size%10=9 then 1 else 0 end Noncredit, case when p_partkey%50=0 then 0 else 10+p_size end Enrollment, cast((10+p_size)*3 as double)/30 FTES, cast(54+p_size%3*18 as double) Standard_Hours, cast(270 as double) Teaching_Load from (select distinct Section_Number, College, Year_Semester from enrollments) e join part on p_partkey=e.Section_Number where p_partkey%37<>0"
PARTS["student_profiles"] = "select Student_Id, College, Year_Semester, sum(Units) Units_Attempted, sum(case when Grade in ('A','B','C','P') then Units else 0 end) Units_Completed, sum(case when Section_Number%3=0 then Units else 0 end) SGEC_Units, sum(case when Line>=4 then Units else 0 end) Online_Units, min(case when Line>=4 then 1 else 0 end) Online_Only, min(case when Section_Number%3=0 then 1 else 0 end) SGEC_Only, case when Student_Id%9=0 and Year_Semester<19970 then 1 else 0 end PSA_Only, case when Student_Id%8=0 and Year_Semester<19963 then 1 else 0 end Concurrent_Student, lpad(cast((Student_Id%6+1)*100 as varchar(10)),6,'0') Major_Code, cast(floor(Year_Semester/10) as bigint)-1976-Student_Id%20 Term_Age, case when Student_Id%6=0 then 'Transfer' when Student_Id%6=1 then 'Undecided' when Student_Id%6=2 then 'UC/CSU Student' when Student_Id%6=3 then 'Associate''s Degree' when Student_Id%6=4 then 'Career/Job Advancement' else 'Other' end Education_Goal, case when Student_Id%17=0 then 1 else 0 end Military, case when Student_Id%4=0 then 'AB 540' when Student_Id%4=1 then 'California Resident' when Student_Id%4=2 then 'International' else 'Out of State' end Residency_Status, case when Student_Id%19=0 then 1 else 0 end DSPS, case when (Student_Id+Year_Semester)%7=0 then 1 else 0 end EOPS, case when (Student_Id+Year_Semester)%11=0 then 1 else 0 end CalWorks, case when (Student_Id+Year_Semester)%2=0 then 1 else 0 end BOGG, cast((Student_Id*13+Year_Semester)%40 as double)*100 Total_Award, cast((Student_Id*7+Year_Semester)%41 as double)/10 District_Cumulative_GPA from enrollments where Grade<>'E' group by Student_Id, College, Year_Semester"
PARTS["ethnicity_details"] = "select Student_Id, case when Ethnicity='Hispanic/Latino' or Student_Id%12=0 then 1 else 0 end Any_Hispanic, case when Ethnicity='Asian' or Student_Id%15=0 then 1 else 0 end Any_Asian from students"

# The current term `t` and what is derived from it.
PARTS["par"] = f"""select t, t-60 coh_cut, {academic_year('(t-60)')} ay_cut, {academic_year('t')} ay_now,
  cast(({academic_year('(t-60)')}//10000)*10+2 as int) award_cut
  from (select arg_max(Year_Semester, Year_Semester) t from terms
        where College='E' and Term_Start_Date <= DATE '{AS_OF}')"""

PARTS["active_majors"] = """select Major_Code, arg_min(Major, {'newest': -Catalog_Year, 'name': Major}) Major
  from programs, par where College in ('E') and Catalog_Year between ay_now - 60006 and ay_now
    and coalesce(Final_Term, t) >= t group by Major_Code"""

# Awards and the term each one falls in: the largest code started by that day.
PARTS["started"] = """select Term_Start_Date since, max(max(Year_Semester)) over (order by Term_Start_Date) term
  from terms group by Term_Start_Date"""
PARTS["dated_awards"] = """select a.*, term ys from
  (select distinct Student_Id, College, Major_Code, Award_Type, Award_Date from awards where College in ('E')) a
  asof left join started on a.Award_Date >= started.since"""

# Units of a student at a college up to the start of each term they studied there.
PARTS["units_to_date"] = """select Student_Id, College, since, sum(sum(SGEC_Units)) over so_far sgec,
    sum(sum(Online_Units)) over so_far online, nullif(sum(sum(Units_Attempted)) over so_far, 0) tried
  from student_profiles join (select Year_Semester, min(Term_Start_Date) since from terms group by 1)
    using (Year_Semester)
  group by Student_Id, College, since window so_far as (partition by Student_Id, College order by since)"""
PARTS["all_raw"] = """select a.*, sgec/tried SGEC_Units, online/tried Online_Units, Gender, Ethnicity
  from dated_awards a
  asof left join units_to_date u on u.Student_Id=a.Student_Id and u.College=a.College and a.Award_Date >= u.since
  left join students s on s.Student_Id=a.Student_Id"""

_REPORT_ROWS = f"""College, Major_Code, {award_name('Award_Type')} Award_Type, yk Year_Semester_Key,
  {term_label('yk')} Year_Semester, {gender('Gender')} Gender, {ethnicity('Ethnicity')} Ethnicity, Cohort,
  SGEC_Units, Online_Units, ak Academic_Year_Key, {year_label('ak')} Academic_Year,
  {between('ys', 'Cohort')} Terms_to_Complete"""

PARTS["awards_all"] = f"""select {_REPORT_ROWS} from
  (select r.*, c.Cohort, ys yk, {academic_year('ys')} ak from all_raw r
   left join cohorts c on r.Student_Id=c.Student_Id, par where ys >= award_cut and ys <= t) x"""

PARTS["entrants"] = """select distinct Student_Id, Cohort_College College, Cohort from cohorts
  where Cohort_College in ('E')"""
PARTS["cohort_raw"] = "select * from all_raw join entrants using (Student_Id, College)"

PARTS["awards_cohort"] = f"""select {_REPORT_ROWS} from
  (select r.*, case when ys between coh_cut and t and ys%10<4 then ys end yk,
     case when {academic_year('ys')} between ay_cut and ay_now then {academic_year('ys')} end ak
   from cohort_raw r, par where Cohort >= coh_cut and Cohort < t) x"""

# Rolling cohorts: every award row lists the completion cohorts it counts in.
_COUNTS_IN = """list_filter(range(greatest(Year_Semester+1, coh_cut), least(Cohort+60, t)),
    lambda c: c%10 < 4 and Cohort%10 < 4 and Year_Semester%10 < 4 and Year_Semester >= Cohort)"""
PARTS["gen"] = "select cast(unnest(range(coh_cut-130, t)) as int) num from par"
PARTS["cohort_years"] = f"""select Cohort, Year_Semester, cast(unnest({_COUNTS_IN}) as int) Completion_Cohort
  from (select coh_cut, t, cast(unnest(range(coh_cut-59, t)) as int) Cohort from par) e,
    lateral (select cast(unnest(range(e.Cohort, e.Cohort+60)) as int) Year_Semester) a"""
PARTS["active"] = """select College, Major_Code, Award_Type from programs where College in ('E')
  group by all having count(Final_Term) = 0"""
PARTS["roll_sub"] = """select Student_Id, Cohort, College, Major_Code, Award_Type, Award_Date, ys Year_Semester,
    Gender, Ethnicity
  from dated_awards semi join active using (College, Major_Code, Award_Type)
  join entrants using (Student_Id, College) left join students using (Student_Id), par
  where Cohort between coh_cut-70 and t-1"""
PARTS["rolling_raw"] = f"""select * exclude (list), cast(unnest(if(len(list) > 0, list, [null])) as int) Completion_Cohort
  from (select r.*, coalesce({_COUNTS_IN}, []) list from roll_sub r, par)"""
PARTS["rolling"] = f"""select Completion_Cohort Completion_Cohort_Key, {term_label('Completion_Cohort')} Completion_Cohort,
  College, Major_Code, {award_name('Award_Type')} Award_Type, {gender('Gender')} Gender,
  {ethnicity('Ethnicity')} Ethnicity, {between('Year_Semester', 'Cohort')} Terms_to_Complete,
  {season('Completion_Cohort')} Term
  from rolling_raw where Cohort is not null and Completion_Cohort is not null and College is not null
    and Major_Code is not null and Award_Type is not null and Year_Semester is not null
    and Gender is not null and Ethnicity is not null"""
PARTS["seat_effort"] = """select Section_Number, College, Year_Semester, FTES/nullif(Enrollment,0) learning,
    Standard_Hours/Teaching_Load/nullif(Enrollment,0) teaching from sections2"""
PARTS["path"] = """select won.*, sum(learning) FTES, sum(teaching) FTEF, count(*) Enrollments
  from (select distinct Student_Id, College, Cohort, Year_Semester from roll_sub) won
  join enrollments e on e.Student_Id=won.Student_Id and e.Year_Semester between won.Cohort and won.Year_Semester
  left join seat_effort x on x.Section_Number=e.Section_Number and x.Year_Semester=e.Year_Semester
    and x.College=e.College and x.College=won.College, par
  where Grade<>'E' and e.Year_Semester < t group by all"""
PARTS["efficiency_raw"] = """select Completion_Cohort, College, Major_Code, Award_Type,
    count(distinct Student_Id) Completers, sum(FTES) FTES, sum(FTEF) FTEF
  from rolling_raw join path using (Student_Id, College, Cohort, Year_Semester) group by all"""
PARTS["efficiency"] = f"""select Completion_Cohort Completion_Cohort_Key, {term_label('Completion_Cohort')} Completion_Cohort,
  College, Major_Code, {award_name('Award_Type')} Award_Type, Completers, FTES, FTEF, FTES/FTEF Efficiency,
  {season('Completion_Cohort')} Term
  from efficiency_raw where Completion_Cohort is not null and FTES is not null and FTEF is not null
    and FTES/FTEF is not null"""

# The same rows with the student, for counts of people.
PARTS["people_all"] = PARTS["awards_all"].replace("select ", "select Student_Id, ", 1)
PARTS["people_rolling"] = PARTS["rolling"].replace("select ", "select Student_Id, ", 1)

# Courses.
PARTS["studied"] = """select Student_Id, e.Year_Semester, Grade, Discipline, Course, Noncredit from enrollments e
  left join sections2 using (Section_Number, College, Year_Semester), par where Grade<>'E'"""
PARTS["finishers"] = """select Student_Id, College, Major_Code, Award_Type, Award_Date, Cohort
  from awards join entrants using (Student_Id, College), par where Cohort between coh_cut and t"""
PARTS["takers_raw"] = """select distinct f.Student_Id, Discipline, Course, College, Major_Code, Award_Type, Gender, Ethnicity
  from finishers f join studied s on s.Student_Id=f.Student_Id and s.Year_Semester >= Cohort
  left join students d on d.Student_Id=f.Student_Id, par where Cohort < t and s.Year_Semester < t"""
PARTS["takers"] = f"""select Discipline, Course, College, Major_Code, {award_name('Award_Type')} Award_Type,
  {gender('Gender')} Gender, {ethnicity('Ethnicity')} Ethnicity from takers_raw"""
PARTS["top_counts"] = f"""select Course, count(*) n from studied s
  join (select Student_Id, Cohort from finishers where College='E' and Major_Code='{MAJOR}' and Award_Type='{AWARD}') f
    on f.Student_Id=s.Student_Id and s.Year_Semester >= f.Cohort, par
  where f.Cohort < t and s.Year_Semester < t group by Course"""

# Baskets and rules.
PARTS["completion"] = """select Student_Id, Year_Semester, sum(Units_Completed)/nullif(sum(Units_Attempted),0) Completion
  from student_profiles group by Student_Id, Year_Semester"""
PARTS["courses_raw"] = """select distinct Student_Id, Year_Semester, Course, Discipline, Completion
  from studied semi join finishers using (Student_Id) left join completion using (Student_Id, Year_Semester)
  where Noncredit=0"""

# The person-period table of one program at one college.
PARTS["newcomers"] = "select Student_Id, Cohort from entrants, par where College='E' and Cohort between coh_cut and t-1"
PARTS["studies"] = "select p.*, Cohort from student_profiles p join newcomers using (Student_Id) where p.College='E'"
PARTS["later"] = "select s.* from studies s, par where Year_Semester > Cohort and Year_Semester < t"
PARTS["before_entry"] = """select Student_Id, max(PSA_Only) Former_PSA_Student,
  max(Concurrent_Student) Former_Concurrent_Student from studies where Year_Semester < Cohort group by Student_Id"""
PARTS["at_entry"] = f"""select Student_Id, cast(Major_Code='{MAJOR}' as int) Declared_Major_at_Entry
  from studies where Year_Semester = Cohort"""
PARTS["program_award"] = f"""select Student_Id, max(ys) Award_Year_Semester from dated_awards
  where College='E' and Major_Code='{MAJOR}' and Award_Type='{AWARD}' group by Student_Id"""
PARTS["flagged"] = """select l.*, Award_Year_Semester,
    coalesce(cast(Year_Semester >= Award_Year_Semester as int), 0) Earned_Award,
    min(Year_Semester) filter (Year_Semester >= Award_Year_Semester) over (partition by l.Student_Id) first_with_award
  from later l left join program_award using (Student_Id)"""
PARTS["passes"] = """select Student_Id, s.Year_Semester, Course from studied s, par
  where Grade in ('A','B','C','P') and s.Year_Semester < t"""


def rules_parts(prefix: str, where: str, item: str = "Course") -> None:
    """All itemsets of every basket, level by level, and the rules from the frequent ones."""
    PARTS[f"{prefix}_items"] = (
        f"select distinct Student_Id, Year_Semester, {item} Course from courses_raw where {where}")
    PARTS[f"{prefix}_sets"] = f"""recursive
      select Student_Id, Year_Semester, [Course] items, Course last_item from {prefix}_items
      union all
      select s.Student_Id, s.Year_Semester, list_append(s.items, i.Course), i.Course
      from {prefix}_sets s join {prefix}_items i on s.Student_Id=i.Student_Id
        and s.Year_Semester=i.Year_Semester and i.Course > s.last_item"""
    PARTS[f"{prefix}_n"] = (
        f"select count(*) n from (select distinct Student_Id, Year_Semester from {prefix}_items) d")
    PARTS[f"{prefix}_frequent"] = f"""select items, count(*) c from {prefix}_sets, {prefix}_n
      group by items, n having count(*) >= (case when 5.0/n > 0.3 then ceil(0.3*n) else 5 end)"""
    PARTS[f"{prefix}_rules"] = f"""select ante, cons, f.c/n support, f.c/a.c confidence,
        (f.c/a.c)/(o.c/n) lift, n baskets, f.c count_both
      from (select items, c, cons, list_filter(items, lambda x: x <> cons) ante
            from (select items, c, unnest(items) cons from {prefix}_frequent where len(items) > 1)) f
      join {prefix}_frequent a on a.items=f.ante join {prefix}_frequent o on o.items=[f.cons], {prefix}_n
      where f.c/a.c >= {PATTERN_CONFIDENCE}
      union all
      select cast([] as varchar[]), items[1], c/n, c/n, 1.0, n, c from {prefix}_frequent, {prefix}_n
      where len(items)=1 and c/n >= {PATTERN_CONFIDENCE}"""
    PARTS[f"{prefix}_pruned"] = f"""select * from {prefix}_rules r where not exists
      (select 1 from {prefix}_rules g where g.cons=r.cons and len(g.ante) < len(r.ante)
       and list_has_all(r.ante, g.ante) and g.confidence >= r.confidence)"""


rules_parts("every", "true")
rules_parts("success", "Completion >= 0.75")
rules_parts("failure", "Completion <= 0.5")
rules_parts("discipline", "true", "Discipline")


def compose(body: str, changed: dict[str, str] | None = None) -> str:
    """Put the sub-queries a statement needs (also indirectly) in front of it, some of them changed."""
    parts_now = PARTS | (changed or {})
    pattern = re.compile(r"\b(" + "|".join(sorted(PARTS, key=len, reverse=True)) + r")\b")
    ordered: list[str] = []

    def visit(text: str, inside: str | None = None) -> None:
        for name in dict.fromkeys(pattern.findall(text)):
            if name != inside and name not in ordered:
                visit(parts_now[name], name)
                ordered.append(name)

    visit(body)
    if not ordered:
        return body
    recursive = any(parts_now[n].startswith("recursive") for n in ordered)
    parts = ",\n".join(f"{n} as ({parts_now[n].removeprefix('recursive').strip()})" for n in ordered)
    own = body.lstrip()
    body = f",\n{own.removeprefix('with ')}" if own.startswith("with ") else f"\n{own}"
    return f"with {'recursive ' if recursive else ''}{parts}{body}"
