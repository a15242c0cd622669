"""Report output: readable headers, and a written table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

SORT_KEYS = ("Academic_Year_Key", "Year_Semester_Key", "Completion_Cohort_Key")


def report_columns(df: DataFrame, helpers: Sequence[str] = SORT_KEYS) -> DataFrame:
    """Drop helper columns and put blanks for underscores in the headers."""
    shown = df.drop(*helpers)
    return shown.toDF(*[name.replace("_", " ") for name in shown.columns])


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = report_columns(df).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
