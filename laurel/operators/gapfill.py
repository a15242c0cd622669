"""Zero rows for level combinations without data, and the wide layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def level_grid(spark: SparkSession, levels: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of declared levels, generated row by row from short lists."""
    grid = spark.range(1).select()
    for name, values in levels.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid


def missing_levels(df: DataFrame, levels: Mapping[str, Sequence]) -> DataFrame:
    """Combinations of declared levels that no row of `df` has."""
    seen = df.select(*levels).distinct()
    return level_grid(df.sparkSession, levels).join(seen, list(levels), "left_anti")


def fill_levels(df: DataFrame, levels: Mapping[str, Sequence], target: str, value=0) -> DataFrame:
    """Append declared combinations without data, with `value` as the target.

    One pass over `df`: the grid is stacked below it and a grid row survives only where
    no data row shares its keys, so the input plan is not run twice.
    """
    keys = list(levels)
    kind = df.schema[target].dataType
    columns = [*keys, target]
    data = df.select(*columns).withColumn("_data", F.lit(1))
    grid = level_grid(df.sparkSession, levels).select(
        *[F.col(k).cast(df.schema[k].dataType) for k in keys],
        F.lit(value).cast(kind).alias(target),
    ).withColumn("_data", F.lit(0))
    has_data = F.max("_data").over(W.partitionBy(*keys))
    return (
        data.unionByName(grid)
        .withColumn("_has_data", has_data)
        .where((F.col("_data") == 1) | (F.col("_has_data") == 0))
        .select(*columns)
    )


def _zero(kind: T.DataType) -> Column:
    return F.lit(0).cast(kind)


def fill_observed(cells: DataFrame, dimensions: Sequence[str], measures: Sequence[str],
                  within: Sequence[str] = ()) -> DataFrame:
    """Zero cells for every combination of the levels observed in `cells`.

    `cells` must be aggregated (one row per combination): there are at most a few
    thousand cells per `within` group, because every dimension is a short list of names
    or calendar terms. So the grid is built inside one row from the observed sets; the
    plan below runs once and cells are not joined with cells.
    """
    kinds = {f.name: f.dataType for f in cells.schema.fields}
    sets = [F.collect_set(F.struct(d)).alias(f"_set_{d}") for d in dimensions]
    body = F.collect_list(F.struct(*dimensions, *measures)).alias("_cells")
    grouped = cells.groupBy(*within).agg(*sets, body)
    zeros = [_zero(kinds[m]).alias(m) for m in measures]

    def combine(remaining: Sequence[str], chosen: list[Column]) -> Column:
        if not remaining:
            return F.struct(*chosen, *zeros)
        first, *rest = remaining
        inner = F.transform(
            F.col(f"_set_{first}"), lambda level: combine(rest, [*chosen, level[first].alias(first)])
        )
        return F.flatten(inner) if rest else inner

    stacked = grouped.select(*within, F.inline(F.concat("_cells", combine(dimensions, []))))
    totals = [F.sum(m).cast(kinds[m]).alias(m) for m in measures]
    return stacked.groupBy(*within, *dimensions).agg(*totals)


def pivot_strata(cells: DataFrame, period_key: str, label_of, period_levels: Sequence[int],
                 stratum: str, strata_levels: Sequence[str]) -> DataFrame:
    """Long to wide: a count and a "<stratum> Proportion" column per stratum.

    One row for every declared period and observed award type, zeros where no data.
    `label_of` turns the period key into its label column.
    """
    label = period_key.removesuffix("_Key")
    entry = F.struct(period_key, stratum, "Count", "Proportion")
    kinds = {c: cells.schema[c].dataType for c in (period_key, stratum, "Count", "Proportion")}
    empty = [
        F.struct(
            F.lit(level).cast(kinds[period_key]).alias(period_key),
            F.lit(None).cast(kinds[stratum]).alias(stratum),
            F.lit(None).cast(kinds["Count"]).alias("Count"),
            F.lit(None).cast(kinds["Proportion"]).alias("Proportion"),
        )
        for level in period_levels
    ]
    known = cells.where(F.col(period_key).isin(list(period_levels)))
    rows = known.groupBy("Award_Type").agg(F.collect_list(entry).alias("_cells")).select(
        "Award_Type", F.inline(F.concat("_cells", F.array(*empty)))
    )
    wide = rows.groupBy(period_key, "Award_Type").pivot(stratum, list(strata_levels)).agg(
        F.sum("Count").alias("Count"), F.sum("Proportion").alias("Proportion")
    )
    shown = [
        column
        for level in strata_levels
        for column in (
            F.coalesce(F.col(f"`{level}_Count`"), F.lit(0)).alias(level),
            F.coalesce(F.col(f"`{level}_Proportion`"), F.lit(0.0)).alias(f"{level} Proportion"),
        )
    ]
    return wide.select(period_key, label_of(F.col(period_key)).alias(label), "Award_Type", *shown)


