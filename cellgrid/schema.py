"""Cells, and when two of them are equal.

A cell is (book, sheet, row, col) with a tagged raw value: kind n (number), s (text), b (boolean) or
e (error literal), null for a blank; `formula` and `formatted` are texts. Blank cells are absent rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROW, MAX_COL = 1_048_576, 16_384
CELL_COLUMNS = ["sheet", "row", "col", "kind", "num", "str", "bool", "err", "formula", "formatted"]
KEY = ["sheet", "row", "col"]
#: Error literals of a grid: fixed values.
ERRORS = (
    "#NULL! #DIV/0! #VALUE! #REF! #NAME? #NUM! #N/A #GETTING_DATA #SPILL! #CALC! #FIELD! #BLOCKED! #CONNECT! #UNKNOWN! #BUSY! #PYTHON!"
).split()


def place(frame: DataFrame) -> list[str]:
    """The columns that tell a frame's cells apart: KEY, and the book where the frame has one."""
    return (["book"] if "book" in frame.columns else []) + KEY


def sheet_of(frame: DataFrame) -> list[str]:
    """The columns that tell a frame's sheets apart."""
    return [c for c in place(frame) if c not in ("row", "col")]


def raw(prefix: str = "") -> Column:
    """The comparison basis of a cell: its tag and values together."""
    return F.struct(*(F.col(prefix + c).alias(c) for c in ("kind", "num", "str", "bool", "err")))


def same_raw(left: str, right: str) -> Column:
    """Null-safe raw equality; NaN equals NaN and -0.0 equals 0.0."""
    return raw(left).eqNullSafe(raw(right))


def cells(table: DataFrame, row: Column, sheet: str, columns: list[str] | None = None) -> DataFrame:
    """The populated cells of a table: a cell per row and column, `row` giving the coordinate; a column's place is its ordinal.

    One unpivot in the scan's own stage; nulls are blanks and give no cell.
    """
    kinds = dict(table.dtypes)
    columns = columns or table.columns
    empty = {"num": "double", "str": "string", "bool": "boolean"}

    def cell(at: int, name: str) -> Column:
        kind = "b" if kinds[name] == "boolean" else "s" if kinds[name] in ("string", "date") or kinds[name].startswith("timestamp") else "n"
        slot = {"n": "num", "s": "str", "b": "bool"}[kind]
        value = F.date_format(name, "yyyy-MM-dd") if kinds[name].startswith("timestamp") else F.col(name)
        fields = [F.when(F.lit(slot == s), value.cast(t)).otherwise(F.lit(None).cast(t)).alias(s) for s, t in empty.items()]
        return F.struct(F.lit(at).alias("col"), F.lit(kind).alias("kind"), *fields, F.col(name).isNotNull().alias("there"))

    out = table.select(row.cast("long").alias("row"), F.explode(F.array(*(cell(i + 1, c) for i, c in enumerate(columns)))).alias("c"))
    return out.filter("c.there").select(
        F.lit(sheet).alias("sheet"), "row", "c.col", "c.kind", "c.num", "c.str", "c.bool", F.lit(None).cast("string").alias("err"), F.lit(None).cast("string").alias("formula"), F.lit(None).cast("string").alias("formatted")
    )
