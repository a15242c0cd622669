from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest

from laurel.operators import stats
from small import dicts

SCHEMA = "Award_Type string, Gender string, Terms_to_Complete int"


@pytest.fixture(scope="module")
def times(spark):
    source = random.Random(7)
    rows = [("A", source.choice("MF"), int(source.gauss(12, 6))) for _ in range(400)]
    rows += [("B", "M", 44), ("B", "M", 3), ("B", "F", 4), ("A", "M", 60), ("A", "M", -30)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def years(rows, award, gender=None):
    return sorted(t / 4 for a, g, t in rows if a == award and gender in (None, g))


def test_medians(times):
    rows, df = times
    for row in dicts(stats.group_medians(df, ["Award_Type"], overall=True)):
        assert row["Median_Years"] == statistics.median(years(rows, row["Award_Type"]))
        assert row["Median_Years_Overall"] == statistics.median(t / 4 for _, _, t in rows)
        assert row["Group_Size"] == len(years(rows, row["Award_Type"]))


def test_unsplit_histogram(times):
    rows, df = times
    bins = dicts(stats.histogram(df))
    assert sum(b["Count"] for b in bins) == len(rows)
    for b in bins:
        assert b["Bin_End"] - b["Bin_Start"] == 1 and (b["Bin_Start"] - 0.5).is_integer()
        assert b["Count"] == sum(b["Bin_Start"] <= y < b["Bin_End"] for y in years(rows, b["Award_Type"]))


def test_split_histogram(times):
    rows, df = times
    bins = dicts(stats.histogram(df, ["Gender"]))
    assert sum(b["Count"] for b in bins) == len(rows)
    for b in bins:
        values = years(rows, b["Award_Type"], b["Gender"])
        width = 1 if max(years(rows, b["Award_Type"])) > 10 else 0.5
        assert b["Bin_End"] - b["Bin_Start"] == width
        assert ((b["Bin_Start"] + width / 2) / width).is_integer()
        assert b["Count"] == sum(b["Bin_Start"] < y <= b["Bin_End"] for y in values)


def test_density(times):
    rows, df = times
    curves = {}
    for r in dicts(stats.density(df, ["Gender"], points=256)):
        curves.setdefault((r["Award_Type"], r["Gender"]), []).append((r["X"], r["Density"], r["Bandwidth"]))
    assert set(curves) == {("A", "M"), ("A", "F"), ("B", "M")}  # one value only: left out
    for (award, gender), points in curves.items():
        values = np.array([t for a, g, t in rows if (a, g) == (award, gender)], float)
        q1, q3 = np.percentile(values, [25, 75])
        spread = min(values.std(ddof=1), (q3 - q1) / 1.34) or values.std(ddof=1)
        width = 0.9 * spread * len(values) ** -0.2
        panel = [t for a, _, t in rows if a == award]
        grid = np.linspace(min(panel), max(panel), 256)
        expected = np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2).sum(1) / (
            len(values) * width * math.sqrt(2 * math.pi))
        xs, ys, widths = map(np.array, zip(*sorted(points)))
        assert np.allclose(widths, width) and np.allclose(xs, grid) and np.allclose(ys, expected)
    xs, ys, _ = zip(*sorted(curves["A", "F"]))
    assert abs(np.trapezoid(ys, xs) - 1) < 0.01


def test_density_of_equal_values_has_a_bandwidth(spark):
    df = spark.createDataFrame([("A", "M", 8), ("A", "M", 8), ("A", "M", 12)], SCHEMA)
    bandwidths = {r["Bandwidth"] for r in dicts(stats.density(df, points=4))}
    assert len(bandwidths) == 1 and bandwidths.pop() > 0


@pytest.mark.parametrize("value, spread", [(8, 8.0), (-8, 8.0), (0, 1.0)])
def test_density_bandwidth_of_equal_values(spark, value, spread):
    df = spark.createDataFrame([("A", "M", value)] * 3 + [("A", "F", 9)], SCHEMA)
    curve = [r for r in dicts(stats.density(df, ["Gender"], points=4)) if r["Gender"] == "M"]
    assert {round(r["Bandwidth"], 9) for r in curve} == {round(0.9 * spread * 3 ** -0.2, 9)}


def test_boxplot(times):
    rows, df = times
    for box in dicts(stats.boxplot(df, ["Award_Type"])):
        values = np.array(years(rows, box["Award_Type"]))
        q1, q2, q3 = np.percentile(values, [25, 50, 75])
        assert (box["Lower_Hinge"], box["Median_Years"], box["Upper_Hinge"]) == (q1, q2, q3)
        inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
        assert (box["Lower_Whisker"], box["Upper_Whisker"]) == (inside.min(), inside.max())
        assert box["Outlier_Count"] == len(values) - len(inside)
        listed = [o["value"] for o in box["Outliers"] for _ in range(o["n"])]
        assert sorted(listed) == sorted(v for v in values if v not in set(inside))
