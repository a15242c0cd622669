"""Every registered query against its SQL, and what its plan must not contain."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.catalog import CHECKS, session_for
from checks.compare import compare, connect
from laurel.operators import counting
from laurel.operators.selection import AWARD_TERM
from laurel.plans import datasets, reports

FOLDER = "/root/testdata/sf0.01"  # the smaller one leaves some results empty
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
            "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"]


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_matches_sql(spark, connection, name):
    assert compare(spark, connection, FOLDER, name) == []


@pytest.mark.parametrize("name", list(CHECKS))
def test_plan(spark, name):
    plan = CHECKS[name].plan(session_for(spark, FOLDER))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert [u for u in UNWANTED if u in text] == []


def test_driver_contract(spark):
    assert entry(spark).count() > 0
    assert set(CHECKS) <= set(oracle_sql()) <= set(queries())


def plan_text(spark, name):
    plan = CHECKS[name].plan(session_for(spark, FOLDER))
    return plan._jdf.queryExecution().executedPlan().toString()


def test_award_window_reaches_the_scan(spark):
    assert "GreaterThanOrEqual(o_orderdate" in plan_text(spark, "report_completers_selected")


@pytest.mark.parametrize("name", ["efficiency", "rolling_cohorts"])
def test_countable_awards_reach_the_scan(spark, name):
    text = plan_text(spark, name)
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_pruning_and_empty_left_sides_are_seen(spark):
    session = session_for(spark, FOLDER)
    every = CHECKS["course_rules_all"].plan(session).collect()
    assert any(r["antecedent"] == "" for r in every)
    assert CHECKS["course_rules_pruned"].plan(session).count() < len(every)
    longer = CHECKS["discipline_rules"].plan(session).collect()
    assert any("," in r["antecedent"] for r in longer)
    assert CHECKS["discipline_rules_pruned"].plan(session).count() < len(longer)


def test_sorted_frames_keep_their_order(spark):
    session = session_for(spark, FOLDER)
    rows = counting.sort_by_period(
        reports.completers(session.awards(), AWARD_TERM), "Year_Semester_Key").collect()
    keys = [(r["Award_Type"], r["Year_Semester_Key"]) for r in rows]
    assert keys == sorted(keys, key=lambda k: (k[0], k[1] is not None, k[1]))
    table = session.table_rows().select("Student_Id", "Year_Semester").repartition(5)
    keys = [tuple(r) for r in datasets.sort_person_period(table).collect()]
    assert keys == sorted(keys) and len(keys) > 1000


def test_reports_that_need_no_units_do_not_scan_enrollments(spark):
    assert "lineitem" not in plan_text(spark, "report_completers_gender")
    assert "lineitem" in plan_text(spark, "report_sgec")


def _below(node, wanted):
    """The nearest nodes of these kinds under each Generate of an optimized plan."""
    found, open_nodes = [], [node]
    while open_nodes:
        node = open_nodes.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        open_nodes += children
        if node.nodeName() == "Generate":
            under = children[0]
            while under.nodeName() not in wanted:
                under = under.children().apply(0)
            found.append(under.nodeName())
    return found


@pytest.mark.parametrize("name", [
    "change_in_completers", "report_change_completers_gender", "median_time_to_award_ethnicity",
    "time_boxplot", "report_change_time", "efficiency"])
def test_only_counted_runs_are_listed_by_cohort(spark, name):
    """No award is repeated per cohort: what is exploded has been aggregated before."""
    plan = CHECKS[name].plan(session_for(spark, FOLDER))._jdf.queryExecution().optimizedPlan()
    # Paths deal the short list of students to groups; that is the only other list.
    nearest = _below(plan, {"Aggregate", "Window", "Join"})
    assert nearest and set(nearest) <= {"Aggregate", "Window"}
