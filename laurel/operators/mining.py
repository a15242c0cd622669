"""Courses that go together: baskets, itemsets and association rules.

All sets of baskets are mined at once (`frequent_itemsets`). The itemsets, each with every item left
out once, form a lattice (`itemset_lattice`) that is stored; rules, closed itemsets and generators are
read off its edges, and so is which rules say nothing new (`prune_rules`).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions.recode import safe_ratio
from laurel.operators import awards as A
from laurel.operators.paths import joined_enrollments
from laurel.operators.selection import filter_completion_band
from laurel.sources.calendar import Calendar
from laurel.sources.domain import Domain
from laurel.sources.storage import cut_lineage

MAX_SUPPORT = 0.3  # fixed value


def term_completion_ratio(profiles: DataFrame) -> DataFrame:
    """Completed / attempted units per student and term, over all colleges."""
    return profiles.groupBy("Student_Id", "Year_Semester").agg(
        safe_ratio(F.sum("Units_Completed"), F.sum("Units_Attempted")).alias("Completion")
    )


def student_term_courses(domain: Domain, calendar: Calendar, majors: Sequence[str] | None,
                         colleges: Sequence[str], years: int, item: str = "Course") -> DataFrame:
    """Distinct credit courses per student and term of the cohort's completers.

    `item` is the section column that counts as a course, such as "Discipline" for coarser
    baskets; it is called Course in the result.

    Awards only select students here, before the enrollments meet the sections.
    """
    return courses_taken(domain, calendar, majors, colleges, years, item).distinct()


def courses_taken(domain: Domain, calendar: Calendar, majors: Sequence[str] | None,
                  colleges: Sequence[str], years: int, item: str = "Course") -> DataFrame:
    """`student_term_courses` with a row per enrollment, for a step that drops repeats itself."""
    cohorts = A.entry_cohorts(domain, calendar.years_back(years), calendar.current_term, colleges,
                              include_current=True)
    awards = A.filter_program(domain.awards, colleges, majors).select("Student_Id", "College")
    people = A.join_entry_cohort(awards.distinct(), cohorts, colleges).select("Student_Id").distinct()
    credit = domain.sections2.where(F.col("Noncredit") == 0).withColumn("Course", F.col(item))
    courses = joined_enrollments(domain, credit, people, None, None, "Course", how="inner")
    return courses.select("Student_Id", "Year_Semester", "Course")


def course_baskets(courses: DataFrame, completion: DataFrame) -> DataFrame:
    """One basket per student and term, with the term's completion ratio.

    Courses may repeat. They are gathered as a set on both sides of the one shuffle, so a basket is
    never larger than the course catalogue.
    """
    keys = ["Student_Id", "Year_Semester"]
    baskets = courses.groupBy(*keys).agg(F.array_sort(F.collect_set("Course")).alias("Courses"))
    return baskets.join(completion, keys, "left")


def basket_sets(success_cutoff: float = 0.75, failure_cutoff: float = 0.5) -> dict[str, Column]:
    """Conditions of the sets of baskets that are mined beside all of them."""
    return {"success": F.col("Completion") >= success_cutoff, "failure": F.col("Completion") <= failure_cutoff}


def success_baskets(baskets: DataFrame, cutoff: float = 0.75) -> DataFrame:
    return filter_completion_band(baskets, at_least=cutoff)


def failure_baskets(baskets: DataFrame, cutoff: float = 0.5) -> DataFrame:
    return filter_completion_band(baskets, at_most=cutoff)


def needed_count(baskets: int, min_students: int) -> int:
    """Baskets that must hold an itemset: `min_students`, but no more than MAX_SUPPORT of them."""
    if baskets and min_students / baskets > MAX_SUPPORT:
        return math.ceil(MAX_SUPPORT * baskets)
    return max(min_students, 1)


ALL_BASKETS = "all"
_MARK = "\0"  # starts the items that stand for a set of baskets


def frequent_itemsets(baskets: DataFrame, sets: Mapping[str, Column] | None = None,
                      min_students: int = 5, item: str = "Courses") -> DataFrame:
    """(Set, items, freq, baskets) of all baskets and of the `sets` that conditions choose, stored.

    One mining serves all sets. A basket gets an item more for every set it is in; the count of
    an itemset together with that item is its count in the set. The miner keeps what the set
    with the least demand needs, and each set then keeps its own.

    `baskets` should be stored (see `cut_lineage`): they are read three times.
    """
    sets = dict(sets or {})
    amounts = baskets.agg(F.count(F.lit(1)), *[F.count(F.when(c, 1)) for c in sets.values()]).first()
    sizes = dict(zip([ALL_BASKETS, *sets], amounts))
    needed = {name: needed_count(n, min_students) for name, n in sizes.items()}
    marks = F.array(*[F.when(c, F.lit(_MARK + name)) for name, c in sets.items()]).cast("array<string>")
    marked = baskets.select(F.concat(item, F.array_compact(marks)).alias(item))
    # The miner rounds support * baskets up; half a basket less makes sure that it gives the count.
    support = (min(needed.values()) - 0.5) / max(sizes[ALL_BASKETS], 1)
    model = FPGrowth(itemsCol=item, minSupport=min(support, 1.0)).fit(marked)
    is_mark = lambda x: x.startswith(_MARK)
    found = model.freqItemsets.select(
        F.filter("items", is_mark).alias("marks"),
        F.array_sort(F.filter("items", lambda x: ~is_mark(x))).alias("items"), "freq",
    ).where((F.size("marks") <= 1) & (F.size("items") > 0))
    name = F.coalesce(F.substring(F.get("marks", F.lit(0)), 2, 1000), F.lit(ALL_BASKETS))
    known = F.create_map(*[F.lit(x) for k, n in needed.items() for x in (k, F.struct(
        F.lit(n).cast("bigint").alias("needed"), F.lit(sizes[k]).cast("bigint").alias("baskets")))])
    limits = known[F.col("Set")]
    return cut_lineage(found.select(name.alias("Set"), "items", "freq").withColumn("_of", limits).where(
        F.col("freq") >= F.col("_of.needed")).select("Set", "items", "freq", "_of.baskets"))


def itemset_lattice(itemsets: DataFrame) -> DataFrame:
    """(Set, items, left, right, freq, left_freq, right_freq, baskets): every itemset with each of its
    items left out once, and how often each part occurs."""
    out = itemsets.select("Set", "items", "freq", "baskets", F.explode("items").alias("right"))
    edges = out.withColumn("left", F.array_remove("items", F.col("right")))
    smaller = itemsets.select("Set", F.col("items").alias("left"), F.col("freq").alias("left_freq"))
    single = itemsets.where(F.size("items") == 1).select(
        "Set", F.col("items")[0].alias("right"), F.col("freq").alias("right_freq"))
    return (
        edges.join(smaller, ["Set", "left"], "left").join(single, ["Set", "right"])
        .withColumn("left_freq", F.coalesce("left_freq", "baskets"))  # nothing is in every basket
        .select("Set", "items", "left", "right", "freq", "left_freq", "right_freq", "baskets")
    )


def closed_itemsets(lattice: DataFrame) -> DataFrame:
    """(Set, items, freq) of the itemsets that no larger one equals in its baskets."""
    own = lattice.select("Set", "items", "freq").distinct()
    covered = lattice.where((F.col("freq") == F.col("left_freq")) & (F.size("left") > 0))
    return own.join(covered.select("Set", F.col("left").alias("items")).distinct(), ["Set", "items"], "left_anti")


def generators(lattice: DataFrame) -> DataFrame:
    """(Set, items, freq) of the itemsets that no smaller one equals in its baskets."""
    return lattice.groupBy("Set", "items", "freq").agg(F.min("left_freq").alias("least")).where(
        F.col("freq") < F.col("least")).drop("least")


def lattice_rules(lattice: DataFrame, confidence: float = 0.8, max_items: int | None = None) -> DataFrame:
    """Rules antecedent => consequent (one item) with support, confidence and lift, per Set.

    Includes rules with an empty left side: items held by at least `confidence` of all
    baskets. `max_items` leaves out rules with more items on both sides together.
    """
    sure = F.col("freq") / F.col("left_freq")
    chosen = lattice.where(sure >= confidence)
    if max_items is not None:
        # An empty left side and a single item on it are the shortest rules.
        chosen = chosen.where((F.size("left") == 0) | (F.size("left") < max_items))
    return chosen.select(
        "Set", F.col("left").alias("antecedent"), F.col("right").alias("consequent"),
        (F.col("freq") / F.col("baskets")).alias("support"), sure.alias("confidence"),
        (sure / (F.col("right_freq") / F.col("baskets"))).alias("lift"), "baskets",
    )


def association_rules(baskets: DataFrame, min_students: int = 5, confidence: float = 0.8,
                      max_items: int | None = None, item: str = "Courses") -> DataFrame:
    """Rules of one set of baskets (see `lattice_rules`), mined when this is called."""
    itemsets = frequent_itemsets(baskets, None, min_students, item)
    return lattice_rules(itemset_lattice(itemsets), confidence, max_items).drop("Set")


def _drop_one(rules: DataFrame, *keys: str) -> DataFrame:
    """Every way to leave out one item of the left side, as `smaller`."""
    without = F.transform("antecedent", lambda x: F.array_remove("antecedent", x))
    return rules.select(*keys, "antecedent", "consequent", "confidence", F.explode(without).alias("smaller"))


def _drop_more(rules: DataFrame, *keys: str) -> DataFrame:
    """Every way to leave out two items of the left side or more."""
    size = F.size("antecedent")
    masks = F.filter(F.sequence(F.lit(0).cast("bigint"), F.call_function("shiftleft", F.lit(1).cast("bigint"), size) - 1),
                     lambda m: F.bit_count(m) <= size - 2)
    held = lambda m: lambda x, place: F.call_function("shiftright", m, place).bitwiseAND(1) == 1
    subsets = F.transform(masks, lambda m: F.filter("antecedent", held(m)))
    return rules.where(size >= 2).select(
        *keys, "antecedent", "consequent", "confidence", F.explode(subsets).alias("smaller"))


def prune_rules(rules: DataFrame) -> DataFrame:
    """Drop rules for which a smaller left side gives the same right side as surely.

    Leaving out one item is tried first. It removes every rule whose left side is no generator,
    as the smaller side then occurs in the same baskets, and most others. Only the rules that
    each item of their left side makes surer are compared with all their smaller sides.
    """
    keys = [c for c in ("Set",) if c in rules.columns]
    rule = [*keys, "antecedent", "consequent"]
    sides = rules.select(*keys, F.col("antecedent").alias("smaller"), "consequent",
                         F.col("confidence").alias("_sure"))
    for without in (_drop_one, _drop_more):
        beaten = without(rules, *keys).join(sides, [*keys, "smaller", "consequent"]).where(
            F.col("_sure") >= F.col("confidence"))
        rules = rules.join(beaten.select(*rule).distinct(), rule, "left_anti")
    return rules


def rules_table(rules: DataFrame) -> DataFrame:
    """Rules with a readable label `{a,b} => {c}` and the number of baskets behind them."""
    label = F.format_string(
        "{%s} => {%s}", F.concat_ws(",", "antecedent"), F.col("consequent")
    )
    return rules.select(
        *[c for c in ("Set",) if c in rules.columns], label.alias("rules"), "support", "confidence", "lift",
        F.round(F.col("support") * F.col("baskets")).cast("bigint").alias("count"),
    )
