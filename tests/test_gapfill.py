from __future__ import annotations

from laurel.functions.terms import academic_year_label
from laurel.operators.gapfill import fill_levels, fill_observed, missing_levels, pivot_strata
from laurel.operators.selection import Strata
from small import dicts

CELLS = [("A", 20153, "M", 3, 0.75), ("A", 20153, "F", 1, 0.25), ("B", 20160, "M", 2, 1.0)]
SCHEMA = "Award_Type string, Key int, Gender string, Count bigint, Proportion double"


def test_observed_levels_are_filled_once(spark):
    cells = spark.createDataFrame(CELLS, SCHEMA)
    dims, measures = ["Award_Type", "Key", "Gender"], ["Count", "Proportion"]
    once = fill_observed(cells, dims, measures)
    rows = sorted(map(tuple, once.collect()))
    assert len(rows) == 8 and sum(r[3] for r in rows) == 6
    assert ("B", 20153, "F", 0, 0.0) in rows and ("A", 20153, "M", 3, 0.75) in rows
    assert sorted(map(tuple, fill_observed(once, dims, measures).collect())) == rows
    assert once.schema["Count"].dataType == cells.schema["Count"].dataType


def test_fill_within_groups_keeps_missing_level(spark):
    cells = spark.createDataFrame([("x", "A", None, 1), ("x", "B", 1, 1), ("y", "A", 2, 5)],
                                  "g string, a string, k int, n bigint")
    rows = {tuple(r) for r in fill_observed(cells, ["a", "k"], ["n"], ["g"]).collect()}
    assert rows == {("x", "A", None, 1), ("x", "A", 1, 0), ("x", "B", 1, 1), ("x", "B", None, 0),
                    ("y", "A", 2, 5)}


def test_declared_levels(spark):
    df = spark.createDataFrame([("A", "M", 4), ("A", "M", 6)], "Award_Type string, Gender string, Count bigint")
    levels = {"Award_Type": ["A", "B"], "Gender": ["M", "F"]}
    assert {tuple(r) for r in missing_levels(df, levels).collect()} == {("A", "F"), ("B", "M"), ("B", "F")}
    filled = fill_levels(df, levels, "Count", 7)
    assert sorted(map(tuple, filled.collect())) == [
        ("A", "F", 7), ("A", "M", 4), ("A", "M", 6), ("B", "F", 7), ("B", "M", 7)]
    assert fill_levels(filled, levels, "Count", 7).count() == 5


def test_wide_layout(spark):
    cells = spark.createDataFrame(
        [("A", 20152016, "Male", 3, 0.75), ("A", 20152016, "Female", 1, 0.25), ("B", 20162017, "Male", 2, 1.0)],
        "Award_Type string, Academic_Year_Key int, Gender string, Count bigint, Proportion double")
    wide = pivot_strata(cells, "Academic_Year_Key", academic_year_label, [20152016, 20162017, 20172018],
                        "Gender", list(Strata.by_gender().genders))
    rows = {(r["Award_Type"], r["Academic_Year"]): r for r in dicts(wide)}
    assert len(rows) == 6
    assert rows["A", "2015-16"]["Male"] == 3 and rows["A", "2015-16"]["Female Proportion"] == 0.25
    assert rows["B", "2017-18"]["Male"] == 0 and rows["B", "2017-18"]["Male Proportion"] == 0.0
