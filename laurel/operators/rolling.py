"""Rolling completion cohorts: each award counts in every cohort window it falls in.

The cohorts of an award are one run of terms. So an award needs only the borders of its run
(`with_span`), and what a report counts per cohort follows from a sweep over the borders of all
awards (`count_by_cohort`): plus n where a run begins, minus n where it has ended, and a running
sum in between. Rows per award and cohort are made for the data set that lists them, not for
counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.functions import terms as T


def completion_cohorts(award_term: Column, cohort: Column, first: int, current: int,
                       cohort_length: int) -> Column:
    """Array of completion cohorts an award belongs to, from its own row alone.

    Cohort c counts awards earned before c by students who entered less than
    `cohort_length` years before c. At most four per year of window.
    """
    low = F.greatest(award_term + 1, F.lit(first))
    high = F.least(cohort + (cohort_length * 10 - 1), F.lit(current - 1))
    valid = (award_term >= cohort) & T.is_regular_term(award_term) & T.is_regular_term(cohort)
    return F.when(valid, T.term_range(low, high))


START, END = "Start", "End"  # running numbers of the first cohort and of the term after the last one
COHORT_KEY = "Completion_Cohort_Key"


def with_span(awards: DataFrame, first: int, current: int, cohort_length: int) -> DataFrame:
    """Add the run of completion cohorts of each award; awards without any go.

    The same cohorts as `completion_cohorts`, as running numbers of terms. Codes between two
    regular terms are no cohorts, so a run begins at the next regular term.
    """
    term, cohort = F.col("Year_Semester"), F.col("Cohort")
    low = F.greatest(term + 1, F.lit(first))
    high = F.least(cohort + (cohort_length * 10 - 1), F.lit(current - 1))
    valid = (term >= cohort) & T.is_regular_term(term) & T.is_regular_term(cohort)
    start = T.term_year(low) * 4 + F.least(T.term_digit(low), F.lit(4))
    end = T.term_year(high) * 4 + F.least(T.term_digit(high), F.lit(3)) + 1
    spanned = awards.withColumns({START: F.when(valid, start), END: F.when(valid, end)})
    return spanned.where(F.col(START) < F.col(END))


def cohorts_of_span(start: Column | str = START, end: Column | str = END) -> Column:
    """Running numbers of the cohorts in a run."""
    end = F.col(end) if isinstance(end, str) else end
    return F.sequence(F.col(start) if isinstance(start, str) else start, end - 1)


def count_by_cohort(spans: DataFrame, keys: Sequence[str], name: str = "Count",
                    weight: str | None = None) -> DataFrame:
    """(keys..., Completion_Cohort_Key, name): rows per key whose run holds the cohort.

    Rows are first counted per run, which combines map-side: a key has a few hundred runs at
    most, however many awards. The rest works on their borders. A row stands for `weight`
    awards.
    """
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    runs = spans.groupBy(*keys, START, END).agg(amount.alias("_n"))
    borders = F.array(
        F.struct(F.col(START).alias("_at"), F.col("_n").alias("_change")),
        F.struct(F.col(END).alias("_at"), (-F.col("_n")).alias("_change")),
    )
    # A key's borders are few, so one shuffle by key serves the sum and the sweep.
    dealt = runs.select(*keys, F.inline(borders)).repartition(*keys)
    changes = dealt.groupBy(*keys, "_at").agg(F.sum("_change").alias("_change"))
    line = W.partitionBy(*keys).orderBy("_at")
    swept = changes.select(
        *keys, "_at", F.sum("_change").over(line).alias(name), F.lead("_at").over(line).alias("_until"))
    listed = swept.where(F.col(name) > 0).select(
        *keys, F.explode(cohorts_of_span("_at", "_until")).alias("_at"), name)
    return listed.select(*keys, T.term_of_index(F.col("_at")).alias(COHORT_KEY), name)


def without_overlap(spans: DataFrame, person: Sequence[str], name: str = "Fresh") -> DataFrame:
    """Add where the part of a run begins that no earlier run of the same person covers.

    Over the runs of a person a cohort lies in [name, End) of exactly one if it lies in any, so
    counting those counts persons. A run that is covered has `name` >= End. One task sees all rows
    of a person, so repeated runs should be gone.
    """
    before = W.partitionBy(*person).orderBy(START, END).rowsBetween(W.unboundedPreceding, -1)
    covered = F.max(END).over(before)
    return spans.withColumn(name, F.greatest(F.col(START), F.coalesce(covered, F.col(START))))


def explode_completion_cohorts(awards: DataFrame, first: int, current: int,
                               cohort_length: int, keep_unmatched: bool = True) -> DataFrame:
    windows = completion_cohorts(F.col("Year_Semester"), F.col("Cohort"), first, current,
                                 cohort_length)
    generate = F.explode_outer if keep_unmatched else F.explode
    return awards.select("*", generate(windows).alias("Completion_Cohort"))


def cohort_grid(spark: SparkSession, first: int, current: int, cohort_length: int) -> DataFrame:
    """All (Cohort, Year_Semester, Completion_Cohort) triples of the rolling rule.

    Generated downwards from each completion cohort, so that no invalid triple is ever
    made. The reports do not need it; it lists the rule itself.
    """
    completion = F.col("Completion_Cohort")
    bounds = spark.range(1).select(F.explode(T.term_range(F.lit(first), F.lit(current - 1)))
                                   .alias("Completion_Cohort"))
    entered = T.term_range(completion - (cohort_length * 10 - 1), completion - 1)
    with_entry = bounds.select("*", F.explode(entered).alias("Cohort"))
    earned = T.term_range(F.col("Cohort"), completion - 1)
    return with_entry.select("Cohort", F.explode(earned).alias("Year_Semester"), "Completion_Cohort")
