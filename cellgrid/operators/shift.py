"""Structural edits: where lines, spans and references go when lines are inserted, deleted or moved.

Coordinates are mapped by column expressions; formula text by one tokenizer in an Arrow UDF.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.a1 import col_letters, col_number
from cellgrid.schema import MAX_COL, MAX_ROW, place


@dataclass(frozen=True)
class Edit:
    """axis: row or col; op: insert, delete or move; `at` is 1-based; dest: for a move, the line before which it goes.

    last_row: the grid's last row, as references see it; None for a table, whose rows have no end.
    """

    axis: str
    op: str
    at: int
    count: int = 1
    dest: int = 0
    sheet: str = ""
    last_row: int | None = MAX_ROW


def line(p: Column, op: Column | str, at: Column | int, count: Column | int, dest: Column | int = 0) -> Column:
    """Where line `p` goes; null if it is deleted."""
    op, at, count, dest = (x if isinstance(x, Column) else F.lit(x) for x in (op, at, count, dest))
    end = at + count
    inserted = F.when(p >= at, p + count).otherwise(p)
    deleted = F.when(p < at, p).when(p >= end, p - count)
    down = F.when((p >= at) & (p < end), p + dest - end).when((p >= end) & (p < dest), p - count).otherwise(p)
    up = F.when((p >= at) & (p < end), p - at + dest).when((p >= dest) & (p < at), p + count).otherwise(p)
    moved = F.when(dest > end, down).when(dest < at, up).otherwise(p)
    return F.when(op == "insert", inserted).when(op == "delete", deleted).when(op == "move", moved)


def span(head: Column, tail: Column, op: Column | str, at: Column | int, count: Column | int, dest: Column | int = 0) -> Column:
    """struct<head, tail> of a span's new ends; null if nothing of it is left or a move would turn it round.

    A deletion clamps: an end inside the deleted band goes to the band's edge.
    """
    op, at, count = (x if isinstance(x, Column) else F.lit(x) for x in (op, at, count))
    end = at + count
    head_left = F.when(head < at, head).when(head >= end, head - count).otherwise(at)
    tail_left = F.when(tail < at, tail).when(tail >= end, tail - count).otherwise(at - 1)
    clamped = F.when(head_left <= tail_left, F.struct(head_left.alias("head"), tail_left.alias("tail")))
    a, b = line(head, op, at, count, dest), line(tail, op, at, count, dest)
    either = F.struct(a.alias("head"), b.alias("tail"))
    return F.when(op == "delete", clamped).when(op == "insert", either).when(a <= b, either)


def cells(frame: DataFrame, edit: Edit) -> DataFrame:
    """The cells after an edit; those in a deleted band go."""
    here = F.col("sheet") == edit.sheet if edit.sheet else F.lit(True)
    moved = line(F.col(edit.axis), edit.op, edit.at, edit.count, edit.dest)
    return frame.withColumn(edit.axis, F.when(here, moved).otherwise(F.col(edit.axis))).filter(F.col(edit.axis).isNotNull())


# the driver-side and UDF-side forms of the same maps


def line_of(p: int, edit: Edit) -> int | None:
    end = edit.at + edit.count
    if edit.op == "insert":
        return p + edit.count if p >= edit.at else p
    if edit.op == "delete":
        return p if p < edit.at else p - edit.count if p >= end else None
    if edit.dest > end:
        return p + edit.dest - end if edit.at <= p < end else p - edit.count if end <= p < edit.dest else p
    if edit.dest < edit.at:
        return p - edit.at + edit.dest if edit.at <= p < end else p + edit.count if edit.dest <= p < edit.at else p
    return p


def span_of(head: int, tail: int, edit: Edit) -> tuple[int, int] | None:
    turned = head > tail
    if turned:
        head, tail = tail, head
    if edit.op == "delete":
        end = edit.at + edit.count
        head = head if head < edit.at else head - edit.count if head >= end else edit.at
        tail = tail if tail < edit.at else tail - edit.count if tail >= end else edit.at - 1
        out = (head, tail) if head <= tail else None
    else:
        head, tail = line_of(head, edit), line_of(tail, edit)
        out = (head, tail) if edit.op == "insert" or head <= tail else None
    return out and (out[::-1] if turned else out)


_SHEET = r"(?:'(?:[^']|'')*'|(?:\[[^\]]*\])?[^\W\d][\w.]*(?::[^\W\d][\w.]*)?)!"


def _tokens(digits: str) -> re.Pattern:
    row = rf"\$?[1-9][0-9]{digits}"
    cell = rf"\$?[A-Za-z]{{1,3}}{row}"
    return re.compile(
        rf"(?P<text>\"(?:[^\"]|\"\")*\")|(?P<sheet>{_SHEET})?(?P<ref>{cell}(?::{cell})?|\$?[A-Za-z]{{1,3}}:\$?[A-Za-z]{{1,3}}|{row}:{row})(?![\w.(!])"
        rf"|(?P<word>[^\W\d][\w.]*|'(?:[^']|'')*'!?|\d[\w.]*)"
    )


_TOKEN = _tokens("{0,6}")
_OPEN_TOKEN = _tokens("*")
_END = re.compile(r"(\$?)([A-Za-z]{1,3})?(\$?)([1-9][0-9]*)?$")


def _tokenizer(last_row: int | None) -> re.Pattern:
    return _TOKEN if last_row == MAX_ROW else _OPEN_TOKEN


def _end(text: str, last_row: int | None = MAX_ROW):
    """(column absolute, column or None, row absolute, row or None) of one end of a reference; None off the grid."""
    m = _END.match(text)
    if not m:
        return None
    first, name, second, digits = m.groups()
    col = col_number(name) if name else None
    row = int(digits) if digits else None
    if name and col is None or row is not None and last_row is not None and row > last_row:
        return None
    return (first if name else "", col, second if name else first or second, row)


def _shown(end) -> str:
    col_abs, col, row_abs, row = end
    return (f"{col_abs}{col_letters(col)}" if col else "") + (f"{row_abs}{row}" if row else "")


def shift_reference(ref: str, edit: Edit) -> str | None:
    """A reference's text after an edit; None if it becomes #REF!."""
    ends = [_end(t, edit.last_row) for t in ref.split(":")]
    if None in ends:
        return ref
    at = 3 if edit.axis == "row" else 1
    limit = edit.last_row if edit.axis == "row" else MAX_COL
    if any(e[at] is None for e in ends):  # whole rows or columns of the other axis
        return ref
    if len(ends) == 1:
        new = line_of(ends[0][at], edit)
        moved = None if new is None else (new,)
    else:
        moved = span_of(ends[0][at], ends[1][at], edit)
    if moved is None or limit is not None and max(moved) > limit:
        return None
    return ":".join(_shown((*e[:at], m, *e[at + 1 :])) for e, m in zip(ends, moved, strict=True))


def _scoped(prefix: str | None, host: str, sheet: str) -> bool:
    """Whether a reference with this qualifier, in a formula on sheet `host`, is on `sheet`."""
    if not prefix:
        return host.lower() == sheet.lower()
    name = prefix[:-1]
    if name.startswith("'"):
        name = name[1:-1].replace("''", "'")
    return not name.startswith("[") and name.lower() == sheet.lower()


def shift_formula(formula: str, edit: Edit, host: str = "") -> tuple[str, int]:
    """(formula after the edit, number of references changed). Quoted text, names, functions and other books stay."""
    changed = 0

    def one(m: re.Match) -> str:
        nonlocal changed
        if not m["ref"] or not _scoped(m["sheet"], host or edit.sheet, edit.sheet):
            return m[0]
        new = shift_reference(m["ref"], edit)
        if new == m["ref"]:
            return m[0]
        changed += 1
        return (m["sheet"] or "") + ("#REF!" if new is None else new)

    return _tokenizer(edit.last_row).sub(one, formula), changed


def offset_formula(formula: str, rows: int, cols: int, last_row: int | None = MAX_ROW) -> str:
    """The formula as filled `rows` down and `cols` right: relative parts move, absolute ones stay, off the grid is #REF!.

    `last_row` as in `Edit`.
    """

    def moved(end):
        col_abs, col, row_abs, row = end
        col = col + cols if col and not col_abs else col
        row = row + rows if row and not row_abs else row
        ok = (col is None or 1 <= col <= MAX_COL) and (row is None or 1 <= row and (last_row is None or row <= last_row))
        return (col_abs, col, row_abs, row) if ok else None

    def one(m: re.Match) -> str:
        if not m["ref"]:
            return m[0]
        ends = [_end(t, last_row) for t in m["ref"].split(":")]
        if None in ends:
            return m[0]
        ends = [moved(e) for e in ends]
        return (m["sheet"] or "") + ("#REF!" if None in ends else ":".join(map(_shown, ends)))

    return _tokenizer(last_row).sub(one, formula)


def references(formula: str) -> list[tuple[str | None, str]]:
    """(sheet qualifier, reference) of a formula, in order."""
    return [(m["sheet"], m["ref"]) for m in _TOKEN.finditer(formula) if m["ref"]]


def template(formula: str) -> str:
    """The formula with its references replaced by their position: equal for copies of one formula."""
    slots: dict[str, int] = {}

    def one(m: re.Match) -> str:
        return f"#{slots.setdefault(m[0], len(slots))}" if m["ref"] else m[0]

    return _TOKEN.sub(one, formula)


def shifted(formula: Column, edit: Edit, host: str = "") -> Column:
    """`shift_formula` over a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else shift_formula(t, edit, host)[0])

    return run(formula)


def filled(formula: Column, rows: Column, cols: Column, last_row: int | None = MAX_ROW) -> Column:
    """`offset_formula` over columns."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, down: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else offset_formula(t, int(r), int(c), last_row) for t, r, c in zip(texts, down, right, strict=True)])

    return run(formula, rows, cols)


def normalised(formula: Column) -> Column:
    """`template` over a column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else template(t))

    return run(formula)


def sqref(text: Column, edit: Edit) -> Column:
    """Space-separated ranges after an edit; consumed ones are dropped."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else " ".join(r for r in (shift_reference(x, edit) for x in t.split()) if r))

    return run(text)


def residuals(formulas: DataFrame, edit: Edit) -> DataFrame:
    """Reasons to refuse an edit: (book where there is one,) sheet, row, col, reason. A move refuses ranges that partly overlap the moved span."""
    f = F.col("formula")
    bare = F.regexp_replace(f, r'"[^"]*"', "")
    rules = {
        "array_formula_present": F.coalesce(F.col("f_kind") == "array", F.lit(False)),
        "threeD_span_unverifiable": bare.rlike(r"[A-Za-z0-9_]+:[A-Za-z0-9_]+!"),
        "non_ascii_sheet_qualifier": bare.rlike(r"[^\x00-\x7F'][^'!\x00-\x20]*!") & ~bare.rlike(r"'[^']*'!"),
        "table_unsupported": bare.rlike(r"[A-Za-z_]\w*\[[^\]0-9]"),
    }
    if edit.op == "move":
        end = edit.at + edit.count

        @F.pandas_udf("boolean")
        def straddles(texts: pd.Series) -> pd.Series:
            def one(t):
                for _, ref in references(t or ""):
                    ends = [_end(x) for x in ref.split(":")]
                    at = 3 if edit.axis == "row" else 1
                    if len(ends) == 2 and None not in ends and None not in (ends[0][at], ends[1][at]):
                        lo, hi = sorted((ends[0][at], ends[1][at]))
                        if lo < end and hi >= edit.at and not (edit.at <= lo and hi < end):
                            return True
                return False

            return texts.map(one).astype(bool)

        rules["move_straddles_range"] = straddles(f)
    hits = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return formulas.filter("formula is not null").select(*place(formulas), F.explode(hits).alias("reason"))
