"""Exact counts of people that add up over any groups.

A group's people are bits: one table row per group and 32,768 student numbers, 4 KB each. Bits of
groups are merged by "or", so the people of several years, awards or strata together are counted from
the groups' rows, and students are shuffled once however many totals are asked for.

It pays where groups are few and large. For many small groups, such as programs by cohort,
`rolling.without_overlap` counts people without bitmaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.sources.storage import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def number_students(ids: DataFrame, column: str = "Student_Id") -> DataFrame:
    """(column, Number): the distinct ids numbered from 1 without gaps, in order.

    Every partition of the stored, sorted ids numbers its own rows; what comes before a
    partition is a sum over as many rows as there are partitions. Nulls get no number.
    """
    ordered = cut_lineage(
        ids.select(column).where(F.col(column).isNotNull()).distinct()
        .repartitionByRange(column).sortWithinPartitions(column))
    placed = ordered.withColumn("_at", F.monotonically_increasing_id())
    placed = placed.select(column, F.shiftright("_at", _ROW_BITS).alias("_part"),
                           F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(before, "_part").select(column, (F.col("_before") + F.col("_row") + 1).alias("Number"))


def bitmaps(rows: DataFrame, keys: Sequence[str], number: str = "Number") -> DataFrame:
    """(keys..., Bucket, Bits): the numbers of each group. Repeats set the same bit."""
    return rows.groupBy(*keys, F.bitmap_bucket_number(number).alias("Bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("Bits"))


def merged() -> Column:
    """The people in any of the groups, as an aggregate; keep Bucket among the keys."""
    return F.bitmap_or_agg("Bits").alias("Bits")


def count_people(maps: DataFrame, keys: Sequence[str], name: str = "People") -> DataFrame:
    return maps.groupBy(*keys).agg(F.sum(F.bitmap_count("Bits")).alias(name))
