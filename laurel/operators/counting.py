"""Counts, running counts and shares over report cells.

The group-by in `count_cells` is the only step that sees the large input; it combines
map-side, so a cell holding a third of all rows costs one partial row per task. What
comes after works on cells: award names x periods x strata, all short level lists.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.functions.recode import percent_label


def count_cells(df: DataFrame, keys: Sequence[str], name: str = "Count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def running_count(cells: DataFrame, order: str, within: Sequence[str]) -> DataFrame:
    """Cumulative count in chronological order of the integer key."""
    so_far = (
        W.partitionBy(*within)
        .orderBy(F.col(order).asc_nulls_last())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return cells.withColumn("Count", F.sum("Count").over(so_far))


def with_share(cells: DataFrame, within: Sequence[str]) -> DataFrame:
    """Add `Proportion` = Count / total of its group, and the printed label."""
    total = F.sum("Count").over(W.partitionBy(*within))
    return with_label(cells.withColumn("Proportion", F.col("Count") / total))


def with_label(cells: DataFrame) -> DataFrame:
    return cells.withColumn("Proportion_Label", percent_label(F.col("Proportion")))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def label_groups(groups: Mapping[str, DataFrame] | DataFrame) -> DataFrame:
    """Stack completer groups under a `Group` column; a single group needs none.

    A frame that has the column, such as `award_groups`, is returned as it is.
    """
    if isinstance(groups, DataFrame):
        return groups
    frames = list(groups.items())
    if len(frames) == 1:
        return frames[0][1]
    stacked = None
    for name, frame in frames:
        named = frame.withColumn("Group", F.lit(name))
        stacked = named if stacked is None else stacked.unionByName(named)
    return stacked


def sort_by_period(df: DataFrame, period_key: str, strata: Sequence[str] = ()) -> DataFrame:
    """Order for display: by the integer key, never by the label."""
    return df.orderBy("Award_Type", *strata, period_key)
