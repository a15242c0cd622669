"""Time the headline queries and print one JSON line.

`store_domain` derives the domain tables from the generated parquet files and writes them
once; the queries then read the stored tables, as reports on a warehouse do. Both are part
of the total. Results are computed in full and discarded by the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

import laurel
from checks.catalog import CHECKS, Session

HEADLINE = [
    "awards_all", "awards_cohort", "rolling_cohorts", "efficiency", "course_takers",
    "course_patterns", "top_program_courses", "survival_person_period", "report_completers",
    "report_time_to_award", "report_sgec", "report_online", "report_change_completers_gender",
    "report_change_efficiency", "report_change_time", "report_course_taking_gender",
    "time_histogram", "time_density", "time_boxplot",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # The test files are tiny; let them keep all cores busy.
        .config("spark.sql.files.openCostInBytes", "131072")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    def timed(name, action) -> None:
        started = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - started, 3)

    with tempfile.TemporaryDirectory(prefix="bench-") as store:
        small_groups = {"parquet.block.size": "1048576"}
        timed("store_domain", lambda: laurel.derive_domain(spark, folder).save(store, **small_groups))
        session = Session(spark, laurel.Domain.from_parquet(spark, store))
        for name in sys.argv[1:] or HEADLINE:
            timed(name, lambda: CHECKS[name].plan(session).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "completion analytics, headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
