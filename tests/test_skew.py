"""One student with a third of all rows: results stay whole, hot groups stay small."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest

import laurel
from checks import sql as Q
from checks.catalog import CHECKS, session_for
from laurel.operators import awards as A
from laurel.operators.paths import path_terms, term_effort
from small import day_in, dicts, domain, terms

HOT, OTHERS = 1, range(2, 60)


@pytest.fixture(scope="module")
def tables(spark):
    source = random.Random(3)
    codes = [t for t in range(19950, 20013) if t % 10 < 4]
    students = [HOT, *OTHERS]

    def someone():
        return HOT if source.random() < 0.35 else source.choice(OTHERS)

    enrollments = list({
        (s, "E", t, source.randint(1, 12), g) for s, t, g in
        ((someone(), source.choice(codes), source.choice("ABCFEP")) for _ in range(3000))})
    sections = {(n, "E", t) for _, _, t, n, _ in enrollments if n != 12}
    profiles = {(s, t) for s, _, t, _, _ in enrollments}
    return domain(
        spark, terms=terms(19850, 20013),
        students=[(s, source.choice("MF"), source.choice(["White", "Asian"]), "English", 0) for s in students],
        cohorts=[(s, source.choice(codes[:20]), "E") for s in students],
        programs=[("E", f"{m:06}", "P", a, 19981999, None) for m in (100, 200) for a in ("AA", "AS")],
        awards=[(s, "E", f"{source.choice([100, 200]):06}", source.choice(["AA", "AS"]),
                 day_in(source.choice(codes)) + dt.timedelta(days=source.randint(0, 9)), 19981999)
                for s in (someone() for _ in range(1200))],
        enrollments=enrollments,
        sections2=[dict(Section_Number=n, College=c, Year_Semester=t, Discipline="D", Course=f"D {n}",
                        Noncredit=0, Enrollment=n, FTES=n / 4, Standard_Hours=54.0, Teaching_Load=270.0)
                   for n, c, t in sections],
        student_profiles=[dict(Student_Id=s, College="E", Year_Semester=t, Units_Attempted=4,
                               Units_Completed=3, SGEC_Units=t % 3, Online_Units=t % 2) for s, t in profiles],
    )


@pytest.fixture(scope="module")
def calendar(tables):
    return laurel.Calendar.load(tables, dt.date(2001, 9, 1))


@pytest.fixture(scope="module")
def connection(tables):
    connection = duckdb.connect()
    for name in laurel.SCHEMAS:
        frame = tables[name].toArrow()
        connection.register(f"{name}_rows", frame)
        connection.execute(f"create view {name} as select * from {name}_rows")
    return connection


def answer(connection, sql: str) -> list[tuple]:
    """The same SQL as for the registered queries, on the tables of this test."""
    text = Q.compose(sql)
    for name in laurel.SCHEMAS:
        text = text.replace(f"{name} as ({Q.PARTS[name]})", f"{name} as (select * from {name}_rows)")
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in row)
                   for row in connection.execute(text).fetchall()), key=str)


def rows_of(df, columns) -> list[tuple]:
    return sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns)
                   for r in dicts(df)), key=str)


@pytest.mark.parametrize("name, build", [
    ("awards_all", laurel.awards_all), ("awards_cohort", laurel.awards_cohort),
    ("rolling", laurel.rolling_cohorts), ("efficiency", laurel.efficiency),
    ("takers", laurel.course_takers),
])
def test_data_sets_are_whole(tables, calendar, connection, name, build):
    result = build(tables, calendar)
    assert rows_of(result, result.columns) == answer(
        connection, f"select {', '.join(result.columns)} from {name}")


def test_a_student_is_reduced_before_joins(tables, calendar):
    """What meets in per-student joins is bounded by calendar and catalogue, not by rows."""
    history = A.dated_units(tables.student_profiles, calendar, ["E", "W"])
    per_student = history.groupBy("Student_Id", "College").count().agg({"count": "max"}).first()[0]
    assert per_student <= len(calendar.rows)
    people = tables.cohorts.withColumnRenamed("Cohort_College", "College")
    effort = term_effort(tables.enrollments, tables.sections2, calendar.current_term)
    totals = path_terms(effort, people)
    per_student = totals.groupBy("Student_Id").count().agg({"count": "max"}).first()[0]
    assert per_student <= len(calendar.rows)


def test_hot_student_really_is_hot(tables):
    share = tables.enrollments.where(f"Student_Id = {HOT}").count() / tables.enrollments.count()
    assert share > 0.25


def test_hot_section_is_split(spark):
    """Adaptive execution may split the section join: no later step relies on its partitioning."""
    from pyspark.sql import functions as F

    from laurel.operators.paths import term_effort

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
    }
    rows = spark.range(0, 60000, numPartitions=8).select(
        (F.col("id") % 7000).alias("Student_Id"), F.lit("E").alias("College"),
        F.lit(20001).alias("Year_Semester"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 997 + 2).alias("Section_Number"),
        F.lit("A").alias("Grade"))
    sections = spark.range(1, 1000).select(
        F.col("id").alias("Section_Number"), F.lit("E").alias("College"), F.lit(20001).alias("Year_Semester"),
        F.lit(10).alias("Enrollment"), F.lit(5.0).alias("FTES"), F.lit(54.0).alias("Standard_Hours"),
        F.lit(270.0).alias("Teaching_Load"))
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        effort = term_effort(rows, sections, 20013)
        assert sum(r["Enrollments"] for r in effort.collect()) == 60000
        assert "skew=true" in effort._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_hot_student_is_dealt_to_several_groups(spark):
    """Choosing students before the section join neither gathers a hot one nor loses rows."""
    from pyspark.sql import functions as F

    from laurel.operators.paths import of_students

    rows = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 997 + 2).alias("Student_Id"),
        F.col("id").alias("Section_Number"), F.lit(20001).alias("Year_Semester"))
    people = spark.createDataFrame([(1,), (1,), (5,)], "Student_Id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        chosen = of_students(rows, people)
        expected = rows.where("Student_Id in (1, 5)")
        assert chosen.count() == expected.count()
        per_task = [r["count"] for r in chosen.groupBy(F.spark_partition_id()).count().collect()]
        assert max(per_task) < 0.6 * sum(per_task)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan_after_run(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_chosen_students_are_never_broadcast(spark):
    """Ids repeated for the groups look small when shuffled, but take a GB for a million students."""
    from pyspark.sql import functions as F

    from laurel.operators.paths import of_students

    rows = spark.range(0, 30000).select(
        (F.col("id") % 997).alias("Student_Id"), F.col("id").alias("Section_Number"), F.lit(20001).alias("Year_Semester"))
    chosen = of_students(rows, spark.range(5).select(F.col("id").alias("Student_Id")))
    assert "Broadcast" not in plan_after_run(chosen)
    assert chosen.count() == rows.where("Student_Id < 5").count()


def test_person_period_broadcasts_no_student_details(spark, tables):
    """Students, their details and award terms are merged; only the entry cohorts and the calendar may be broadcast."""
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    table = laurel.survival_person_period(tables, calendar, "000100", "AA", ["BOLT 100"])
    left = [line for line in plan_after_run(table).splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in left if "LeftOuter" in line and "Student_Id" in line]
    assert not [line for line in left if "LeftSemi" in line]


def test_parts_are_never_broadcast(spark):
    """The parts grow with the sections; a broadcast would be held whole by the driver and by each task."""
    derived = laurel.derive_domain(spark, "/root/testdata/sf0.001")
    courses = derived.sections2.select("Section_Number", "College", "Year_Semester", "Discipline", "Course")
    plan = plan_after_run(courses)
    assert not [line for line in plan.splitlines() if "HashJoin" in line and "Section_Number" in line]


def test_course_completers_broadcast_no_students(spark, tables):
    """Entry cohorts and students have a row per student; every task would hold a broadcast of them whole."""
    calendar = laurel.Calendar.load(tables, dt.date(2001, 9, 1))
    plan = plan_after_run(laurel.course_completers(tables, calendar))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


COURSE_QUERIES = [
    "course_distribution_ethnicity_gender", "course_distribution_gender", "course_heatmap", "course_takers",
    "join_course_shortlist", "join_group_size", "max_course_share", "report_course_taking",
    "report_course_taking_ethnicity", "report_course_taking_ethnicity_gender", "report_course_taking_gender",
]


@pytest.mark.parametrize("name", COURSE_QUERIES)
def test_course_queries_never_broadcast_by_file_size(spark, name):
    """Compressed files of students or parts look small at any size. The plan before the run goes by them; orders are
    a small table here and may be broadcast."""
    query = CHECKS[name].plan(session_for(spark, "/root/testdata/sf0.001"))
    plan = query._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert "SortMergeJoin" in plan and not [line for line in joins if "o_orderkey" not in line]
