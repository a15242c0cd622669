"""Size of the batches in which rows travel between Spark and Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = 1000  # texts are long: the default of 10,000 rows holds tens of megabytes on either side


def use_small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
