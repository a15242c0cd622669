"""Term codes (`YYYYS`) and academic years (`YYYYYYYY`) as Column expressions.

Everything here stays inside whole-stage codegen; a NULL code gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laurel.functions.levels import SEASON_ORDER, SEASONS


def term_digit(term: Column) -> Column:
    return term % 10


def term_year(term: Column) -> Column:
    return F.call_function("div", term, F.lit(10)).cast("int")


def is_regular_term(term: Column) -> Column:
    """Only the seasons 0-3 exist; other digits are holes in the number line."""
    return term_digit(term) < 4


def term_season(term: Column) -> Column:
    digit = term_digit(term)
    winter, spring, summer, fall = SEASONS
    return (
        F.when(term.isNull(), F.lit(None).cast("string"))
        .when(digit == 0, winter)
        .when(digit == 1, spring)
        .when(digit == 2, summer)
        .otherwise(fall)
    )


def season_rank(season: Column) -> Column:
    """Position of a season name inside its academic year (Summer first)."""
    rank = F.lit(None).cast("int")
    for position, name in enumerate(SEASON_ORDER):
        rank = F.when(season == name, position).otherwise(rank)
    return rank


def term_label(term: Column) -> Column:
    return F.concat(term_season(term), F.lit(" "), term_year(term).cast("string"))


def academic_year(term: Column) -> Column:
    """Summer and Fall open an academic year, Winter and Spring close it."""
    year = term_year(term)
    opens = F.when(term_digit(term).isin(2, 3), year).otherwise(year - 1)
    return opens * 10001 + 1  # the code holds the opening year and the next one


def academic_year_label(year: Column) -> Column:
    text = year.cast("string")
    return F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 7, 2))


def term_index(term: Column) -> Column:
    """Running number of a term, four to a year: 4 * year + digit, with term = 10 * year + digit."""
    return term - term_year(term) * 6


def term_of_index(index: Column) -> Column:
    """Term code of a running number."""
    year = F.call_function("div", index, F.lit(4)).cast("int")
    return index + year * 6


def terms_between(later: Column, earlier: Column) -> Column:
    """Signed number of terms, four to a year."""
    return term_index(later) - term_index(earlier)


def years_from_terms(terms: Column) -> Column:
    return terms / F.lit(4.0)


def term_range(low: Column, high: Column) -> Column:
    """Array of the regular term codes in [low, high]; empty when low > high."""
    codes = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.filter(codes, is_regular_term)


# The same arithmetic on plain driver-side ints, for cut-offs that become literals.

def academic_year_of(term: int) -> int:
    year, digit = divmod(term, 10)
    opens = year if digit in (2, 3) else year - 1
    return opens * 10000 + opens + 1


def academic_year_codes(first: int, last: int) -> list[int]:
    return list(range(first, last + 1, 10001))


def term_codes(first: int, last: int) -> list[int]:
    return [code for code in range(first, last + 1) if code % 10 < 4]
