from __future__ import annotations

import itertools
import random

import pytest

from laurel.operators import mining as M
from small import dicts

SCHEMA = "Courses array<string>"


def baskets(spark, sets):
    return spark.createDataFrame([(sorted(s),) for s in sets], SCHEMA)


def by_force(sets, least, confidence, longest=100):
    counts = {}
    for basket in sets:
        for size in range(1, len(basket) + 1):
            for items in itertools.combinations(sorted(basket), size):
                counts[items] = counts.get(items, 0) + 1
    frequent = {i: c for i, c in counts.items() if c >= least and len(i) <= longest}
    rules = {}
    for items, count in frequent.items():
        for last in items:
            left = tuple(i for i in items if i != last)
            sure = count / (counts[left] if left else len(sets))
            if sure >= confidence:
                rules[left, last] = sure
    return rules


def found(rules):
    return {(tuple(r["antecedent"]), r["consequent"]): r["confidence"] for r in dicts(rules)}


@pytest.mark.parametrize("seed", range(3))
def test_rules_and_pruning_match_brute_force(spark, seed):
    source = random.Random(seed)
    sets = [set(source.sample("abcdefg", source.randint(1, 5))) | ({"h"} if source.random() < 0.9 else set())
            for _ in range(80)]
    rules = M.association_rules(baskets(spark, sets), min_students=4, confidence=0.6)
    expected = by_force(sets, 4, 0.6)
    assert found(rules) == pytest.approx(expected)
    kept = {
        (left, right): sure for (left, right), sure in expected.items()
        if not any(r == right and set(other) < set(left) and s >= sure
                   for (other, r), s in expected.items())
    }
    assert found(M.prune_rules(rules)) == pytest.approx(kept)
    assert ((), "h") in kept


def test_equally_sure_longer_rule_is_redundant(spark):
    schema = "antecedent array<string>, consequent string, support double, confidence double, lift double"
    rules = spark.createDataFrame(
        [(["a"], "c", 0.5, 0.9, 1.0), (["a", "b"], "c", 0.4, 0.9, 1.0), (["a", "d"], "c", 0.4, 0.95, 1.0),
         (["b"], "e", 0.4, 0.8, 1.0), ([], "e", 0.9, 0.9, 1.0)], schema)
    assert set(found(M.prune_rules(rules))) == {(("a",), "c"), (("a", "d"), "c"), ((), "e")}


def test_support_is_not_raised_by_rounding(spark):
    sets = [{"a", "b"}] * 5 + [{"c"}] * 142
    assert (("a",), "b") in found(M.association_rules(baskets(spark, sets), min_students=5))
    assert (("a",), "b") not in found(M.association_rules(baskets(spark, sets), min_students=6))


def test_few_baskets_use_the_largest_support(spark):
    assert M.needed_count(10, 5) == 3 and M.needed_count(17, 5) == 5 and M.needed_count(0, 5) == 5
    sets = [{"a", "b"}] * 3 + [{"c"}] * 7
    assert (("a",), "b") in found(M.association_rules(baskets(spark, sets)))


def test_no_baskets(spark):
    assert found(M.prune_rules(M.association_rules(baskets(spark, [])))) == {}


def test_labels(spark):
    sets = [{"a", "b"}] * 9 + [{"a"}]
    table = {r["rules"]: r for r in dicts(M.rules_table(M.association_rules(baskets(spark, sets))))}
    assert table["{b} => {a}"]["count"] == 9 and table["{} => {a}"]["count"] == 10
    assert table["{} => {a}"]["lift"] == 1.0


def test_long_rules(spark):
    sets = [set("abcdefghijk")] * 6
    rules = M.association_rules(baskets(spark, sets))
    assert max(len(left) for left, _ in found(rules)) == 10
    short = M.association_rules(baskets(spark, sets), max_items=10)
    assert max(len(left) for left, _ in found(short)) == 9
    # All items are in every basket, so the rules with an empty left side say it all.
    assert set(found(M.prune_rules(rules))) == {((), item) for item in "abcdefghijk"}


def test_a_distant_smaller_side_makes_a_rule_redundant(spark):
    """The sides between the two are no rules themselves."""
    schema = "antecedent array<string>, consequent string, support double, confidence double, lift double"
    rules = spark.createDataFrame(
        [(["d"], "z", 0.5, 0.9, 1.0), (["a", "b", "c", "d"], "z", 0.4, 0.9, 1.0),
         (["a", "b", "c", "e"], "z", 0.4, 0.9, 1.0)], schema)
    assert set(found(M.prune_rules(rules))) == {(("d",), "z"), (("a", "b", "c", "e"), "z")}


def test_completion_bands(spark):
    df = spark.createDataFrame([(0.75, ["a"]), (0.5, ["b"]), (0.6, ["c"]), (None, ["d"])],
                               "Completion double, Courses array<string>")
    assert [r["Courses"] for r in M.success_baskets(df).collect()] == [["a"]]
    assert [r["Courses"] for r in M.failure_baskets(df).collect()] == [["b"]]


def by_force_itemsets(sets, least):
    counts = {}
    for basket in sets:
        for size in range(1, len(basket) + 1):
            for items in itertools.combinations(sorted(basket), size):
                counts[items] = counts.get(items, 0) + 1
    return {i: c for i, c in counts.items() if c >= least}


def labelled(spark, seed, n=150):
    source = random.Random(seed)
    rows = [(source.choice([None, 0.2, 0.5, 0.6, 0.75, 1.0]), sorted(source.sample("abcdefg", source.randint(1, 5))))
            for _ in range(n)] + [(0.9, list("abcd"))] * (n // 3)
    return rows, spark.createDataFrame(rows, "Completion double, Courses array<string>").repartition(5)


@pytest.mark.parametrize("seed", range(2))
def test_one_mining_serves_all_sets(spark, monkeypatch, seed):
    rows, df = labelled(spark, seed)
    fits = []
    own = M.FPGrowth.fit
    monkeypatch.setattr(M.FPGrowth, "fit", lambda self, data: (fits.append(1), own(self, data))[1])
    itemsets = M.frequent_itemsets(df, M.basket_sets(), min_students=6)
    assert len(fits) == 1
    chosen = {
        "all": [c for _, c in rows], "success": [c for x, c in rows if x is not None and x >= 0.75],
        "failure": [c for x, c in rows if x is not None and x <= 0.5]}
    for name, sets in chosen.items():
        found = dicts(itemsets.where(f"Set = '{name}'"))
        assert {tuple(r["items"]): r["freq"] for r in found} == by_force_itemsets(sets, M.needed_count(len(sets), 6))
        assert {r["baskets"] for r in found} == {len(sets)}


def test_overlapping_sets_and_an_empty_one(spark):
    rows, df = labelled(spark, 5)
    sets = {"high": M.F.col("Completion") >= 0.5, "low": M.F.col("Completion") <= 0.75, "none": M.F.col("Completion") > 2}
    itemsets = M.frequent_itemsets(df, sets, min_students=4)
    for name, kept in (("high", lambda x: x >= 0.5), ("low", lambda x: x <= 0.75)):
        own = [c for x, c in rows if x is not None and kept(x)]
        assert {tuple(r["items"]): r["freq"] for r in dicts(itemsets.where(f"Set = '{name}'"))} == by_force_itemsets(own, 4)
    assert itemsets.where("Set = 'none'").count() == 0


def test_closed_itemsets_and_generators(spark):
    rows, _ = labelled(spark, 7)
    rows = [(x, sorted({*c, *("f" if "g" in c else "")})) for x, c in rows]  # g never without f
    df = spark.createDataFrame(rows, "Completion double, Courses array<string>")
    lattice = M.itemset_lattice(M.frequent_itemsets(df, None, min_students=5)).cache()
    counts = by_force_itemsets([c for _, c in rows], 5)
    closed = {i for i, c in counts.items() if not any(set(i) < set(j) and c == d for j, d in counts.items())}
    free = {i for i, c in counts.items() if c < len(rows) and not any(set(j) < set(i) and c == d for j, d in counts.items())}
    assert {tuple(r["items"]) for r in dicts(M.closed_itemsets(lattice))} == closed
    assert {tuple(r["items"]) for r in dicts(M.generators(lattice))} == free
    assert len(closed) < len(counts)
    # Every rule that stays has a generator, or nothing, on its left side.
    kept = M.prune_rules(M.lattice_rules(lattice, 0.3))
    assert {tuple(r["antecedent"]) for r in dicts(kept)} <= free | {()}


def test_sets_are_pruned_apart(spark):
    schema = "Set string, antecedent array<string>, consequent string, support double, confidence double, lift double"
    rules = spark.createDataFrame(
        [("x", ["a"], "z", 0.5, 0.9, 1.0), ("x", ["a", "b"], "z", 0.4, 0.9, 1.0), ("y", ["a", "b"], "z", 0.4, 0.9, 1.0),
         ("y", ["c"], "z", 0.4, 0.9, 1.0), ("y", ["a", "b", "c", "d"], "z", 0.4, 0.8, 1.0)], schema)
    assert {(r["Set"], tuple(r["antecedent"])) for r in dicts(M.prune_rules(rules))} == {
        ("x", ("a",)), ("y", ("a", "b")), ("y", ("c",))}


def test_repeated_courses_count_once_in_a_basket(spark):
    """Enrollments are gathered as sets, without a shuffle before that drops repeats."""
    taken = spark.createDataFrame(
        [(1, 19961, "b"), (1, 19961, "a"), (1, 19961, "b"), (1, 19963, "b"), (2, 19961, None)],
        "Student_Id bigint, Year_Semester int, Course string").repartition(5)
    ratio = spark.createDataFrame([(1, 19961, 0.5)], "Student_Id bigint, Year_Semester int, Completion double")
    found = {(r["Student_Id"], r["Year_Semester"]): (r["Courses"], r["Completion"])
             for r in dicts(M.course_baskets(taken, ratio))}
    assert found == {(1, 19961): (["a", "b"], 0.5), (1, 19963): (["b"], None), (2, 19961): ([], None)}


def test_baskets_join_lines_with_orders_once(spark, monkeypatch):
    """Enrollments, sections and profiles come from one join; it is made once and let go."""
    import datetime as dt

    import laurel
    from laurel.plans import datasets as D

    domain = laurel.derive_domain(spark, "/root/testdata/sf0.001")
    calendar = laurel.Calendar.load(domain, dt.date(2001, 9, 1))
    plans, store = [], D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: (
        plans.append(df._jdf.queryExecution().withCachedData().toString()), store(df))[1])
    baskets = D.stored_baskets(domain, calendar)
    assert plans[0].count("InMemoryRelation") == 3
    assert not domain.enrollments.is_cached and not domain.enrollments.storageLevel.useDisk
    plain = M.course_baskets(M.student_term_courses(domain, calendar, None, ("E",), 6),
                             M.term_completion_ratio(domain.student_profiles))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(baskets) == rows(plain) and baskets.count() > 50


def test_tables_that_are_stored_are_not_held(spark, tmp_path):
    import laurel

    domain = laurel.derive_domain(spark, "/root/testdata/sf0.001")
    with domain.held():
        assert domain.enrollments.storageLevel.useDisk
    domain.save(str(tmp_path))
    with domain.held():
        assert not domain.enrollments.storageLevel.useDisk
