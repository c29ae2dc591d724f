"""Difference and certification of two snapshots: one full outer join on the cell's coordinates.

Where both sides have a `book` it is one of the coordinates, so books of a folder are compared each with its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.schema import CELL_COLUMNS, KEY, place, same_raw, sheet_of

CAP = 10_000
SAMPLE = 8


def sheet_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sheets of one side only, with their cells: (book where both have it), sheet, change (added or removed), cells."""
    sheet = [c for c in sheet_of(old) if c in new.columns]
    a = old.groupBy(*sheet).agg(F.count("*").alias("cells"))
    b = new.groupBy(*sheet).agg(F.count("*").alias("cells"))
    added = b.join(a, sheet, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(a.join(b, sheet, "left_anti").withColumn("change", F.lit("removed")))


def _kind() -> Column:
    equal = same_raw("old_", "new_")
    formula = F.col("old_formula").isNotNull()
    return (
        F.when(F.col("old_there").isNull(), "added")
        .when(F.col("new_there").isNull(), "removed")
        .when(~F.col("old_formula").eqNullSafe(F.col("new_formula")), "formula")
        .when(formula & ~equal, "cached_value")
        .when(~formula & ~equal, "value")
        .when(~formula & ~F.col("old_formatted").eqNullSafe(F.col("new_formatted")), "format")
    )


def changes(old: DataFrame, new: DataFrame, all_sheets: bool = False) -> DataFrame:
    """The cells that differ, with `kind` of change; of sheets on both sides unless all_sheets."""
    sides = []
    key = [c for c in place(old) if c in new.columns]
    sheet = [c for c in key if c not in ("row", "col")]
    for prefix, own, other in (("old_", old, new), ("new_", new, old)):
        if not all_sheets:
            own = own.join(other.select(*sheet).distinct(), sheet, "left_semi")
        values = [F.col(c).alias(prefix + c) for c in CELL_COLUMNS if c not in KEY]
        sides.append(own.select(*key, *values, F.lit(True).alias(prefix + "there")))
    both = sides[0].join(sides[1], key, "full")
    return both.withColumn("change", _kind()).filter("change is not null").drop("old_there", "new_there")


def summary(found: DataFrame, by_sheet: bool = False) -> DataFrame:
    """Numbers of changed (formula, value, format), added, removed and cached_value cells."""
    counts = [
        F.count_if(F.col("change").isin("formula", "value", "format")).alias("changed"),
        *(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "cached_value")),
    ]
    return found.groupBy(*sheet_of(found)).agg(*counts) if by_sheet else found.agg(*counts)


def capped(found: DataFrame, cap: int = CAP) -> DataFrame:
    """The first `cap` changes in order of (book,) sheet, row and column; a top-k, so no full sort."""
    return found.orderBy(*place(found)).limit(cap)


def certified(expected: DataFrame, edited: DataFrame) -> DataFrame:
    """One row: the verdict and the number of each kind of difference over the union of sheets. Formats and cached values pass."""
    kinds = ("formula", "value", "added", "removed", "format", "cached_value")
    counts = changes(expected, edited, all_sheets=True).agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds))
    bad = sum((F.col(k) for k in kinds[:4]), F.lit(0))
    return counts.select(F.when(bad == 0, "certified").otherwise("refused").alias("verdict"), *kinds)


def samples(expected: DataFrame, edited: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The first disqualifying differences."""
    bad = changes(expected, edited, all_sheets=True).filter(F.col("change").isin("formula", "value", "added", "removed"))
    return bad.orderBy(*place(bad)).limit(n).select(*place(bad), "change")


def agrees(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-12) -> Column:
    """Numeric agreement within a tolerance; zero agrees with zero only."""
    exact = (a == 0) | (b == 0)
    return F.when(exact, a == b).otherwise(F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b))))


def verdicts(cases: DataFrame, group: str) -> DataFrame:
    """`cases` (group, want, got) -> per group the exact, tolerated and differing cases."""
    want, got = F.col("want"), F.col("got")
    verdict = F.when(want == got, "exact").when(agrees(want, got), "tolerance").otherwise("differ")
    return cases.withColumn("verdict", verdict).groupBy(group).pivot("verdict", ["exact", "tolerance", "differ"]).count().na.fill(0)
