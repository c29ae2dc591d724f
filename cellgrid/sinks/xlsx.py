"""Point edits to workbooks: only the parts of touched sheets change, byte for byte."""

from __future__ import annotations

import html
import io
import math
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame

from cellgrid.a1 import col_letters, col_number
from cellgrid.operators.shift import offset_formula
from cellgrid.sources.xlsx import read_parts, sheets_of

_CELL = re.compile(r"<c\b([^>]*?)(?:/>|>.*?</c>)", re.DOTALL)
_ROW = re.compile(r"<row\b([^>]*?)(?:/>|>(.*?)</row>)", re.DOTALL)


def escaped(text: str) -> str:
    """Text as XML content: control characters, which XML can't hold, are dropped."""
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def cell_xml(ref: str, value, formula: str | None = None, style: str = "") -> str:
    """A cell element: None is blank, numbers that aren't finite are the error #NUM!."""
    f = f"<f>{escaped(formula.removeprefix('='))}</f>" if formula else ""
    if value is None:
        return f'<c r="{ref}"{style}>{f}</c>' if f else f'<c r="{ref}"{style}/>'
    if isinstance(value, bool):
        return f'<c r="{ref}"{style} t="b">{f}<v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        if not math.isfinite(value):
            return f'<c r="{ref}"{style} t="e">{f}<v>#NUM!</v></c>'
        return f'<c r="{ref}"{style}>{f}<v>{value:.17g}</v></c>'
    if f:
        return f'<c r="{ref}"{style} t="str">{f}<v>{escaped(value)}</v></c>'
    space = ' xml:space="preserve"' if value != value.strip() else ""
    return f'<c r="{ref}"{style} t="inlineStr"><is><t{space}>{escaped(value)}</t></is></c>'


def edited_sheet(xml: str, edits: dict[tuple[int, int], tuple]) -> str:
    """A sheet part with cells set: {(row, col): (value, formula or None)}; rows and cells are put in order where they lack."""
    m = re.search(r"<sheetData\s*/>|<sheetData>(.*?)</sheetData>", xml, re.DOTALL)
    if not m:
        raise ValueError("a sheet without sheetData")
    rows: dict[int, tuple[str, dict[int, str]]] = {}
    at = 0
    for r in _ROW.finditer(m[1] or ""):
        found = re.search(r'\br="(\d+)"', r[1])
        at = int(found[1]) if found else at + 1
        cells, col = {}, 0
        for c in _CELL.finditer(r[2] or ""):
            ref = re.search(r'\br="([A-Z]+)\d+"', c[1])
            col = col_number(ref[1]) if ref else col + 1
            cells[col] = c[0]
        rows[at] = (r[1].strip(), cells)
    _write_out_shared(rows, edits)
    for (row, col), (value, formula) in edits.items():
        attributes, cells = rows.setdefault(row, (f'r="{row}"', {}))
        style = re.search(r'\bs="\d+"', cells.get(col, "").split(">")[0])
        cells[col] = cell_xml(f"{col_letters(col)}{row}", value, formula, f" {style[0]}" if style else "")
        rows[row] = (re.sub(r'\s*\bspans="[^"]*"', "", attributes), cells)
    body = "".join(f"<row {a}>{''.join(c for _, c in sorted(cells.items()))}</row>" for _, (a, cells) in sorted(rows.items()))
    out = xml[: m.start()] + f"<sheetData>{body}</sheetData>" + xml[m.end() :]
    used = [(r, c) for r, (_, cells) in rows.items() for c in cells]
    if used and "<dimension" in out:
        (r1, r2), (c1, c2) = ((min(x), max(x)) for x in zip(*used, strict=True))
        out = re.sub(r'<dimension ref="[^"]*"', f'<dimension ref="{col_letters(c1)}{r1}:{col_letters(c2)}{r2}"', out, count=1)
    return out


_FORMULA = re.compile(r"<f\b([^>]*?)(?:/>|>(.*?)</f>)", re.DOTALL)


def _write_out_shared(rows: dict[int, tuple[str, dict[int, str]]], edits: dict[tuple[int, int], tuple]) -> None:
    """Gives cells that share an edited cell's formula a formula of their own."""
    masters, others = {}, []
    for row, (_, cells) in rows.items():
        for col, xml in cells.items():
            f = _FORMULA.search(xml)
            if f and 't="shared"' in f[1] and (si := re.search(r'\bsi="(\d+)"', f[1])):
                if f[2]:
                    masters[si[1]] = (row, col, html.unescape(f[2]))
                else:
                    others.append((si[1], row, col))
    for si, row, col in others:
        if si in masters and masters[si][:2] in edits:
            r0, c0, body = masters[si]
            own = f"<f>{escaped(offset_formula(body, row - r0, col - c0))}</f>"
            cells = rows[row][1]
            cells[col] = _FORMULA.sub(lambda _, own=own: own, cells[col], count=1)


def edited_book(content: bytes, edits: dict[tuple[str, int, int], tuple]) -> bytes:
    """A workbook with cells set: {(sheet, row, col): (value, formula or None)}. An edit of a sheet that isn't there is an error."""
    parts = read_parts(content)
    by_part: dict[str, dict] = {}
    where = {name.lower(): part for name, part, _ in sheets_of(parts)}
    for (sheet, row, col), new in edits.items():
        if sheet.lower() not in where:
            raise ValueError(f"no sheet {sheet!r}")
        by_part.setdefault(where[sheet.lower()], {})[row, col] = new
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, data in parts.items():
            if name == "xl/calcChain.xml" and by_part:
                continue
            if name in by_part:
                data = edited_sheet(data.decode("utf-8"), by_part[name]).encode("utf-8")
            if by_part and name == "[Content_Types].xml":
                data = re.sub(rb"<Override[^>]*calcChain[^>]*/>", b"", data)
            if by_part and name == "xl/_rels/workbook.xml.rels":
                data = re.sub(rb"<Relationship [^>]*calcChain[^>]*/>", b"", data)
            package.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def edited_books(books: DataFrame, edits: DataFrame) -> DataFrame:
    """`books` (book, content) with `edits` (book, sheet, row, col, kind, num, str, bool, formula): (book, content) of the edited ones."""

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"book": [], "content": []})
        value = lambda e: {"n": e.num, "s": e.str, "b": None if e.bool is None else bool(e.bool)}.get(e.kind)
        made = {(e.sheet, int(e.row), int(e.col)): (value(e), e.formula) for e in right.itertuples()}
        return pd.DataFrame({"book": [left.book[0]], "content": [edited_book(left.content[0], made)]})

    return books.groupBy("book").cogroup(edits.groupBy("book")).applyInPandas(run, "book string, content binary")
