"""Exact medians and the numbers behind histogram, density and box plots.

Times to award are whole terms, so a group has few distinct values. Every statistic
first collapses to (group, value, n): the raw rows are only ever counted, and what is
collected per group is its list of distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.functions.terms import years_from_terms

VALUE, WEIGHT = "Years", "n"
GRID_POINTS = 512


def weighted_values(df: DataFrame, keys: Sequence[str], unit: str = "years") -> DataFrame:
    terms = F.col("Terms_to_Complete")
    value = years_from_terms(terms) if unit == "years" else terms.cast("double")
    return df.select(*keys, value.alias(VALUE)).groupBy(*keys, VALUE).agg(
        F.count(F.lit(1)).alias(WEIGHT)
    )


def _percentile(level: float | Sequence[float]) -> Column:
    """Exact percentile with linear interpolation over weighted values."""
    if isinstance(level, float):
        return F.percentile(VALUE, F.lit(level), F.col(WEIGHT))
    return F.percentile(VALUE, F.array(*[F.lit(p) for p in level]), F.col(WEIGHT))


def group_medians(df: DataFrame, keys: Sequence[str], overall: bool = False) -> DataFrame:
    """Size and median per group, and beside it the median of the whole table if asked.

    The overall median is a scalar subquery over the same weighted values, so both read
    one shuffle of them.
    """
    return weighted_medians(weighted_values(df, keys), keys, overall)


def weighted_medians(weights: DataFrame, keys: Sequence[str], overall: bool = False) -> DataFrame:
    """`group_medians` of rows (keys..., Years, n) that stand for n values each."""
    medians = weights.groupBy(*keys).agg(
        F.sum(WEIGHT).alias("Group_Size"), _percentile(0.5).alias("Median_Years")
    )
    if not overall:
        return medians
    return medians.withColumn("Median_Years_Overall", weights.agg(_percentile(0.5)).scalar())


def histogram(df: DataFrame, stratum: Sequence[str] = ()) -> DataFrame:
    """Bin counts of years to award per award type, and stratum if split.

    Unsplit: bins of one year, closed on the left, starting at half years. Split: bins
    centred on multiples of their width and closed on the right; the width is one year
    if the longest time of the award type exceeds ten years, else half a year.
    """
    keys = ["Award_Type", *stratum]
    values = weighted_values(df, keys)
    if stratum:
        longest = F.max(VALUE).over(W.partitionBy("Award_Type"))
        values = values.withColumn("Width", F.when(longest > 10, 1.0).otherwise(0.5))
        width = F.col("Width")
        low = (F.ceil(F.col(VALUE) / width - 0.5) - 0.5) * width
    else:
        values = values.withColumn("Width", F.lit(1.0))
        low = F.floor(F.col(VALUE) - 0.5) + 0.5
    return (
        values.withColumn("Bin_Start", low)
        .withColumn("Bin_End", F.col("Bin_Start") + F.col("Width"))
        .groupBy(*keys, "Bin_Start", "Bin_End")
        .agg(F.sum(WEIGHT).alias("Count"))
    )


def _bandwidth(n: Column, deviation: Column, iqr: Column, first: Column) -> Column:
    """Rule-of-thumb bandwidth.

    Without a quartile range the deviation counts; without that, when all values are equal,
    the value's own size; for zeros, 1.
    """
    spread = F.least(deviation, iqr / 1.34)
    spread = (F.when(spread > 0, spread).when(deviation > 0, deviation)
              .when(F.abs(first) > 0, F.abs(first)).otherwise(1.0))
    return 0.9 * spread * F.pow(n, F.lit(-0.2))


def density(df: DataFrame, stratum: Sequence[str] = (), unit: str = "terms",
            points: int = GRID_POINTS) -> DataFrame:
    """Gaussian kernel density per award type (and stratum) on an even grid.

    The grid spans the range of the award type over all its strata. Groups of fewer than
    two rows have no density. Each grid point sums over the distinct values of its own
    row, so nothing is joined.
    """
    keys = ["Award_Type", *stratum]
    values = weighted_values(df, keys, unit)
    panel = W.partitionBy("Award_Type")
    ranged = values.select(
        "*", F.min(VALUE).over(panel).alias("Low"), F.max(VALUE).over(panel).alias("High")
    )
    n, x = F.col(WEIGHT), F.col(VALUE)
    groups = ranged.groupBy(*keys).agg(
        F.first("Low").alias("Low"), F.first("High").alias("High"),
        F.sum(n).alias("N"), F.sum(n * x).alias("_sum"), F.sum(n * x * x).alias("_squares"),
        _percentile([0.25, 0.75]).alias("_quartiles"),
        F.array_sort(F.collect_list(F.struct(x.alias("x"), n.alias("n")))).alias("_values"),
    ).where(F.col("N") > 1)
    count = F.col("N").cast("double")
    # Terms are whole numbers, so both sums are exact and so is the difference.
    variance = (F.col("_squares") - F.col("_sum") * F.col("_sum") / count) / (count - 1)
    iqr = F.col("_quartiles")[1] - F.col("_quartiles")[0]
    scaled = groups.withColumn("_deviation", F.sqrt(F.greatest(variance, F.lit(0.0)))).withColumn(
        "Bandwidth", _bandwidth(count, F.col("_deviation"), iqr, F.col("_values")[0]["x"])
    )
    step = (F.col("High") - F.col("Low")) / (points - 1)
    grid = scaled.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("Point")
    ).withColumn("X", F.col("Low") + F.col("Point") * step)
    width = F.col("Bandwidth")

    def kernel(total: Column, entry: Column) -> Column:
        u = (F.col("X") - entry["x"]) / width
        return total + entry["n"] * F.exp(-0.5 * u * u)

    mass = F.aggregate("_values", F.lit(0.0), kernel)
    return grid.select(
        *keys, "Point", "X", "Bandwidth",
        (mass / (count * width * math.sqrt(2 * math.pi))).alias("Density"),
    )


def boxplot(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hinges, median, whiskers (furthest values within 1.5 IQR) and outliers.

    Outliers are listed as distinct values with their counts.
    """
    return weighted_boxplot(weighted_values(df, keys), keys)


def weighted_boxplot(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`boxplot` of rows (keys..., Years, n) that stand for n values each."""
    groups = weights.groupBy(*keys).agg(
        F.sum(WEIGHT).alias("Group_Size"),
        _percentile([0.25, 0.5, 0.75]).alias("_q"),
        F.array_sort(F.collect_list(F.struct(F.col(VALUE).alias("value"), F.col(WEIGHT).alias("n"))))
        .alias("_values"),
    )
    q = F.col("_q")
    reach = (q[2] - q[0]) * 1.5
    low, high = q[0] - reach, q[2] + reach
    inside = F.filter("_values", lambda v: v["value"].between(low, high))
    outside = F.filter("_values", lambda v: ~v["value"].between(low, high))
    return groups.select(
        *keys, "Group_Size",
        F.array_min(inside)["value"].alias("Lower_Whisker"),
        q[0].alias("Lower_Hinge"), q[1].alias("Median_Years"), q[2].alias("Upper_Hinge"),
        F.array_max(inside)["value"].alias("Upper_Whisker"),
        F.aggregate(outside, F.lit(0).cast("bigint"), lambda total, v: total + v["n"])
        .alias("Outlier_Count"),
        outside.alias("Outliers"),
    )
