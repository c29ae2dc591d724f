"""Predicates over formulas, SQL texts, names and pairs of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellgrid import a1


def _bare(formula: Column) -> Column:
    return F.regexp_replace(formula, r'"[^"]*"', '""')


def dynamic_reference(formula: Column) -> Column:
    """Whether what a formula reads is only known when it runs."""
    return _bare(formula).rlike(r"(?i)\b(INDIRECT|OFFSET)\s*\(")


def uncertifiable(formula: Column) -> Column:
    """Tables, other sheets, and whole rows or columns: what a template comparison can't follow."""
    bare = _bare(formula)
    return bare.rlike(r"[A-Za-z_]\w*\[") | F.contains(bare, F.lit("!")) | bare.rlike(r"\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}(?![\w(])") | bare.rlike(r"(?<![\w.])\$?\d+:\$?\d+")


def dynamic_sql(expression: Column) -> Column:
    """A CASE whose branch is a column, quoted or not: what is read depends on the data."""
    # fixed values: this pattern and the next one, as they decide alike elsewhere
    return expression.rlike(r'(?is)\bcase\b.*\bthen\b\s*"?[a-z_]')


def leftover_template(sql: Column) -> Column:
    """Whether a template's expression, statement or comment is left."""
    return sql.rlike(r"\{[{%#]")


def looks_like_cell(name: Column) -> Column:
    """Whether a defined name reads as a place on the grid."""
    return a1.parse(name).isNotNull() | name.rlike(r"(?i)^R[1-9][0-9]*C[1-9][0-9]*$")


def multi_cell_formula(f_kind: Column) -> Column:
    return f_kind.isin("array", "shared")


def mentions_sheet(text: Column, sheet: Column) -> Column:
    """Whether a part names the sheet at all, in any case: a test to skip parts by."""
    low, name = F.lower(text), F.lower(sheet)
    return F.contains(low, F.concat(name, F.lit("!"))) | F.contains(low, F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'!")))


def reads_the_same(a: str, b: str) -> Column:
    """Whether two tagged cells (structs) read the same: equal, or both of blank, 0 and ""."""
    x, y = F.col(a), F.col(b)
    empty = lambda c: c.isNull() | c["kind"].isNull() | ((c["kind"] == "n") & (c["num"] == 0)) | ((c["kind"] == "s") & (c["str"] == ""))
    return x.eqNullSafe(y) | (empty(x) & empty(y))


def tier(exact: Column, refused: Column, total: Column) -> Column:
    """What a book's formulas allow: exact, mixed, refused or none."""
    return F.when(total == 0, "none").when(exact == total, "exact").when(refused == total, "refused").otherwise("mixed")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
