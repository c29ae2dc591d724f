"""A1 notation as column expressions: letters, labels, parsing, bounds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellgrid.schema import MAX_COL, MAX_ROW


def letters(col: Column) -> Column:
    """1 -> A, 27 -> AA, 16384 -> XFD; null outside the grid."""
    n = col.cast("int")
    low = F.pmod(n - 1, 26)
    mid = F.pmod(F.floor((n - 27) / 26), 26).cast("int")
    high = F.floor((n - 703) / 676).cast("int")
    one = lambda k: F.char(F.lit(65) + k)
    text = F.when(n <= 26, one(low)).when(n <= 702, F.concat(one(mid), one(low))).otherwise(F.concat(one(high), one(mid), one(low)))
    return F.when(n.between(1, MAX_COL), text)


def number(text: Column) -> Column:
    """A -> 1, XFD -> 16384; null if it is no column of the grid."""
    up = F.upper(text)
    total = F.aggregate(F.split(up, ""), F.lit(0), lambda t, c: F.when(c == "", t).otherwise(t * 26 + F.ascii(c) - 64))
    return F.when(up.rlike("^[A-Z]{1,3}$"), F.when(total <= MAX_COL, total))


def label(row: Column, col: Column) -> Column:
    """`B7`; outside the grid `R{row}C{col}`."""
    fits = row.between(1, MAX_ROW) & col.between(1, MAX_COL)
    return F.when(fits, F.concat(letters(col), row.cast("string"))).otherwise(F.concat(F.lit("R"), row.cast("string"), F.lit("C"), col.cast("string")))


def parse(text: Column) -> Column:
    """struct<row, col> of a plain cell reference; null for `$`, spaces, row 0 and places off the grid."""
    ok = text.rlike("^[A-Za-z]{1,3}[1-9][0-9]{0,6}$")
    row = F.try_to_number(F.regexp_extract(text, r"([0-9]+)$", 1), F.lit("9999999")).cast("int")
    col = number(F.regexp_extract(text, r"^([A-Za-z]+)", 1))
    return F.when(ok & (row <= MAX_ROW) & col.isNotNull(), F.struct(row.alias("row"), col.alias("col")))


def split_sheet(text: Column) -> Column:
    """struct<sheet, cell>: split at the last `!`, quotes taken off, doubled quotes undone."""
    sheet = F.regexp_extract(text, r"^(.*)!([^!]*)$", 1)
    bare = F.when(sheet.rlike("^'.*'$"), F.replace(F.regexp_replace(sheet, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(sheet)
    return F.struct(F.when(F.instr(text, "!") > 0, bare).alias("sheet"), F.regexp_extract(text, r"([^!]*)$", 1).alias("cell"))


def col_letters(n: int) -> str:
    """The same as `letters`, for the driver."""
    out = ""
    while n:
        n, low = divmod(n - 1, 26)
        out = chr(65 + low) + out
    return out


def col_number(text: str) -> int | None:
    if not re.fullmatch("[A-Za-z]{1,3}", text):
        return None
    n = 0
    for c in text.upper():
        n = n * 26 + ord(c) - 64
    return n if n <= MAX_COL else None
