"""Recodes, labels and safe arithmetic as Column expressions (no Python UDFs)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from laurel.functions.levels import AWARD_NAMES, ETHNICITIES, UNKNOWN_AWARD


def award_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(AWARD_NAMES.items())])
    return F.coalesce(names[code], F.lit(UNKNOWN_AWARD))


def recode_gender(code: Column) -> Column:
    """`M` is Male, every other known value Female, unknown stays unknown."""
    return F.when(code.isNotNull(), F.when(code == "M", "Male").otherwise("Female"))


def restrict_levels(value: Column, levels: Sequence[str]) -> Column:
    return F.when(value.isin(list(levels)), value)


def known_ethnicity(value: Column) -> Column:
    return restrict_levels(value, ETHNICITIES)


def stratum_label(ethnicity: Column, gender: Column) -> Column:
    return F.concat(ethnicity, F.lit(" "), gender)


def pad_code(code: Column, width: int = 6) -> Column:
    """Left-pad with zeros; longer codes are kept (`lpad` alone would cut them)."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def share_status(share: Column, limit: float, labels: Sequence[str]) -> Column:
    """labels = (below, at or above) for `limit` percent.

    Rounding to nine digits keeps 0.57 at 57 %, which plain 0.57 * 100 misses.
    """
    below, reached = labels
    return F.when(share.isNotNull(), F.when(F.round(share * 100, 9) >= limit, reached).otherwise(below))


def percent_label(share: Column) -> Column:
    text = F.format_string("%.1f", F.round(share, 3) * 100)
    return F.when(share.isNotNull(), F.concat(text, F.lit(" %")))


def percent_parse(label: Column) -> Column:
    return F.regexp_replace(label, " %", "").try_cast("double")


def round_measure(value: Column, digits: int = 2) -> Column:
    return F.round(value, digits)


def safe_identifier(text: Column) -> Column:
    """Course text usable as a column name: blanks and dots become underscores."""
    return F.translate(text, " .", "__")


def safe_name(text: str) -> str:
    return re.sub(r"[ .]", "_", text)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(condition, 1).otherwise(0)


def zero_if_missing(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def zero_if_nan(value: Column) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """NULL for a zero or missing denominator."""
    return F.try_divide(numerator, denominator)


# Each flag of the person-period table: name -> (source column, value that sets it).
# Fixed values.
INDICATORS = {
    "Transfer_Goal": ("Education_Goal", "Transfer"),
    "Undecided_Goal": ("Education_Goal", "Undecided"),
    "CSU_UC_Student": ("Education_Goal", "UC/CSU Student"),
    "Degree_Goal": ("Education_Goal", "Associate's Degree"),
    "Career_Goal": ("Education_Goal", "Career/Job Advancement"),
    "AB_540_Student": ("Residency_Status", "AB 540"),
    "California_Resident": ("Residency_Status", "California Resident"),
    "International_Student": ("Residency_Status", "International"),
    "Female": ("Gender", "F"),
    "Spanish_Speaking": ("Language", "Spanish"),
    "Chinese_Speaking": ("Language", "Chinese"),
    "Vietnamese_Speaking": ("Language", "Vietnamese"),
}


def indicator_flags(names: Sequence[str] | None = None) -> list[Column]:
    chosen = INDICATORS if names is None else {n: INDICATORS[n] for n in names}
    return [flag(F.col(source) == value).alias(name) for name, (source, value) in chosen.items()]
