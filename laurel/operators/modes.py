"""All split modes of a report in one pass.

A report is shown unsplit, by gender, by ethnicity or by both. Each mode is one of several grouping
sets over the same cells, so the data is read and counted once and only cells are repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions.levels import ALL_STUDENTS
from laurel.functions.recode import stratum_label

STRATA = ("Gender", "Ethnicity")
MODES = {"none": (), "gender": ("Gender",), "ethnicity": ("Ethnicity",), "ethnicity_gender": STRATA}


def over_modes(cells: DataFrame, fixed: Sequence[str], measures: Sequence[Column],
               either: Sequence[str] = ()) -> DataFrame:
    """(Mode, Category, fixed..., either..., measures...) of cells with Gender and Ethnicity.

    Category is the stratum, "All Students" in mode none. A mode leaves out the cells that have no
    level of what it splits by. With `either`, each mode is made once per column named there
    and the others are null.
    """
    sets = [[*fixed, *split, *part] for split in MODES.values() for part in ([c] for c in either or ())]
    sets = sets or [[*fixed, *split] for split in MODES.values()]
    columns = [*fixed, *STRATA, *either]
    grouped = cells.groupingSets(sets, *columns).agg(
        *[F.grouping(c).alias(f"_{c}") for c in (*STRATA, *either)], *measures)
    by_gender, by_ethnicity = (F.col(f"_{c}") == 0 for c in STRATA)
    gender, ethnicity = map(F.col, STRATA)
    known = (~by_gender | gender.isNotNull()) & (~by_ethnicity | ethnicity.isNotNull())
    none, one, other, both = MODES
    mode = (F.when(by_gender & by_ethnicity, both).when(by_gender, one).when(by_ethnicity, other).otherwise(none))
    category = (F.when(by_gender & by_ethnicity, stratum_label(ethnicity, gender)).when(by_gender, gender)
                .when(by_ethnicity, ethnicity).otherwise(ALL_STUDENTS))
    kept = [c for c in grouped.columns if c not in STRATA and c not in [f"_{x}" for x in STRATA]]
    return grouped.where(known).select(mode.alias("Mode"), category.alias("Category"), *kept)


def which(either: Sequence[str]) -> Column:
    """Name of the column of `either` that a row of `over_modes` is grouped by."""
    return F.coalesce(*[F.when(F.col(f"_{c}") == 0, c) for c in either])
