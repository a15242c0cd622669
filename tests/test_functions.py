"""Hand rows for the Column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from laurel.functions import levels as L
from laurel.functions import recode as R
from laurel.functions import terms as T


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_seasons_and_labels(spark):
    terms = [20150, 20151, 20152, 20153, None]
    assert column(spark, terms, "int", T.term_season) == ["Winter", "Spring", "Summer", "Fall", None]
    assert column(spark, terms, "int", T.term_label) == [
        "Winter 2015", "Spring 2015", "Summer 2015", "Fall 2015", None]
    assert column(spark, terms, "int", T.academic_year) == [
        20142015, 20142015, 20152016, 20152016, None]
    assert column(spark, [20142015, 20152016], "int", T.academic_year_label) == ["2014-15", "2015-16"]
    assert column(spark, [19992000], "int", T.academic_year_label) == ["1999-00"]


def test_unknown_digit_is_fall(spark):
    assert column(spark, [20157], "int", T.term_season) == ["Fall"]
    assert column(spark, [20157], "int", T.academic_year) == [20142015]


def test_season_order(spark):
    assert column(spark, ["Spring", "Summer", "x"], "string", T.season_rank) == [3, 0, None]


@pytest.mark.parametrize("later, earlier, terms", [(20173, 20151, 10), (20151, 20173, -10), (20151, 20151, 0)])
def test_terms_between(spark, later, earlier, terms):
    row = spark.range(1).select(T.terms_between(F.lit(later), F.lit(earlier))).first()
    assert row[0] == terms


def test_driver_side_terms_agree_with_columns(spark):
    codes = T.term_codes(19951, 20013)
    assert column(spark, codes, "int", T.academic_year) == [T.academic_year_of(c) for c in codes]
    assert T.academic_year_codes(19951996, 19981999) == [19951996, 19961997, 19971998, 19981999]


def test_term_range(spark):
    df = spark.createDataFrame([(19953, 19961), (19961, 19953)], "a int, b int")
    rows = [r[0] for r in df.select(T.term_range(F.col("a"), F.col("b"))).collect()]
    assert rows == [[19953, 19960, 19961], []]


def test_gender(spark):
    assert column(spark, ["M", "F", "X", None], "string", R.recode_gender) == [
        "Male", "Female", "Female", None]


def test_award_names(spark):
    codes = ["CS", "C", "AA", "AS", "AT", "ST", "CN", "ZZ", None]
    assert column(spark, codes, "string", R.award_name) == [
        *L.AWARD_NAMES.values(), L.UNKNOWN_AWARD, L.UNKNOWN_AWARD]


def test_levels_and_strata(spark):
    assert column(spark, ["White", "Other", None], "string", R.known_ethnicity) == ["White", None, None]
    df = spark.createDataFrame([("White", "Male"), ("White", None)], "e string, g string")
    assert [r[0] for r in df.select(R.stratum_label(F.col("e"), F.col("g"))).collect()] == [
        "White Male", None]


def test_percent_labels(spark):
    assert column(spark, [0.12345, 0.0625, 1.0, None], "double", R.percent_label) == [
        "12.3 %", "6.3 %", "100.0 %", None]
    assert column(spark, ["12.3 %", "100.0 %", "n/a"], "string", R.percent_parse) == [12.3, 100.0, None]


def test_status_limit_is_safe_against_float_error(spark):
    def status(limit):
        return lambda share: R.share_status(share, limit, ["below", "reached"])

    assert column(spark, [0.60, 0.59, None], "double", status(60)) == ["reached", "below", None]
    assert column(spark, [0.57], "double", status(57)) == ["reached"]


def test_codes_and_identifiers(spark):
    assert column(spark, ["100", "000100", "1000000"], "string", R.pad_code) == [
        "000100", "000100", "1000000"]
    assert column(spark, ["MATH 110.5"], "string", R.safe_identifier) == ["MATH_110_5"]
    assert R.safe_name("MATH 110.5") == "MATH_110_5"


def test_safe_arithmetic(spark):
    assert column(spark, [float("nan"), None, 0.5], "double", R.zero_if_nan) == [0.0, 0.0, 0.5]
    assert column(spark, [0, 4, None], "int", lambda x: R.safe_ratio(F.lit(2), x)) == [None, 0.5, None]
    assert column(spark, [None, 3], "int", R.zero_if_missing) == [0, 3]
    assert column(spark, [1.234, 1.235], "double", R.round_measure) == [1.23, 1.24]


def test_indicator_flags(spark):
    df = spark.createDataFrame(
        [("Associate's Degree", "AB 540", "F", "Spanish"), (None, None, None, None)],
        "Education_Goal string, Residency_Status string, Gender string, Language string")
    first, second = (r.asDict() for r in df.select(*R.indicator_flags()).collect())
    assert {k for k, v in first.items() if v} == {
        "Degree_Goal", "AB_540_Student", "Female", "Spanish_Speaking"}
    assert set(second.values()) == {0}
