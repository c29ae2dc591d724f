"""Workbooks as DataFrames: package parts, cells, sheets and defined names.

A workbook is one task's work, read part by part under limits on what its parts unpack to.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.a1 import col_number
from cellgrid.operators.shift import offset_formula

PART_LIMIT, BOOK_LIMIT = 512 << 20, 2 << 30
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "book string, sheet string, sheet_idx int, row long, col int, kind string, num double, str string, bool boolean, err string, formula string, formatted string, f_kind string, si string"
PARTS = "book string, part string, bytes binary, size long, sha256 string"


def limits() -> tuple[int, int]:
    """(bytes of a part, bytes of a book) that may be unpacked; the environment can set others."""
    return int(os.environ.get("CELLGRID_MAX_PART_BYTES", PART_LIMIT)), int(os.environ.get("CELLGRID_MAX_BOOK_BYTES", BOOK_LIMIT))


def read_parts(content: bytes) -> dict[str, bytes]:
    """Part name -> bytes, in the package's order. Raises if a part or the book unpacks to too much, whatever its header says."""
    per_part, left = limits()
    out = {}
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        for entry in package.infolist():
            if entry.is_dir():
                continue
            most = min(per_part, left)
            with package.open(entry) as f:
                data = f.read(most + 1)
            if len(data) > most:
                raise ValueError(f"{entry.filename} unpacks to more than {most} bytes")
            left -= len(data)
            out[entry.filename] = data
    return out


def sheets_of(parts: dict[str, bytes]) -> list[tuple[str, str, str]]:
    """(name, part, state) of each sheet in order, by the workbook's relationships."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(parts["xl/_rels/workbook.xml.rels"])}
    out = []
    for s in ElementTree.fromstring(parts["xl/workbook.xml"]).iter(f"{_MAIN}sheet"):
        target = targets.get(s.get(_REL), "")
        part = target.lstrip("/") if target.startswith("/") else os.path.normpath(f"xl/{target}")
        out.append((s.get("name"), part, s.get("state", "visible")))
    return out


def defined_names_of(parts: dict[str, bytes]) -> list[tuple[str, str]]:
    return sorted((d.get("name"), d.text or "") for d in ElementTree.fromstring(parts["xl/workbook.xml"]).iter(f"{_MAIN}definedName"))


def _texts(parts: dict[str, bytes]) -> list[str]:
    if "xl/sharedStrings.xml" not in parts:
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(parts["xl/sharedStrings.xml"]).iter(f"{_MAIN}si")]


def cells_of(parts: dict[str, bytes]) -> Iterator[tuple]:
    """Cells in the columns of CELLS but the book. Cells without a reference follow the one before; shared formulas are written out."""
    shared = _texts(parts)
    for idx, (sheet, part, _) in enumerate(sheets_of(parts)):
        masters: dict[str, tuple[int, int, str]] = {}
        last_row = 0
        for row in ElementTree.fromstring(parts.get(part, b"<x/>")).iter(f"{_MAIN}row"):
            at = int(row.get("r", last_row + 1))
            last_row, last_col = at, 0
            for c in row.iter(f"{_MAIN}c"):
                ref = re.match(r"([A-Za-z]+)([0-9]+)$", c.get("r", ""))
                col = col_number(ref[1]) if ref else last_col + 1
                last_col = col
                f, v = c.find(f"{_MAIN}f"), c.find(f"{_MAIN}v")
                kind, num, text, flag, err = None, None, None, None, None
                t, value = c.get("t", "n"), v.text if v is not None else None
                if t == "inlineStr":
                    kind, text = "s", "".join(x.text or "" for x in c.iter(f"{_MAIN}t"))
                elif value is not None:
                    if t == "s":
                        kind, text = "s", shared[int(value)]
                    elif t in ("str", "d"):
                        kind, text = "s", value
                    elif t == "b":
                        kind, flag = "b", value.strip() in ("1", "true")
                    elif t == "e":
                        kind, err = "e", value
                    else:
                        kind, num = "n", float(value)
                formula = f_kind = si = None
                if f is not None:
                    f_kind, si = f.get("t", "normal"), f.get("si")
                    body = f.text
                    if f_kind == "shared":
                        if body:
                            masters[si] = (at, col, body)
                        elif si in masters:
                            r0, c0, first = masters[si]
                            body = offset_formula(first, at - r0, col - c0)
                    formula = None if body is None else f"={body}"
                if kind or formula:
                    shown = text if kind == "s" else value
                    yield sheet, idx, at, col, kind, num, text, flag, err, formula, shown, f_kind, si


def _books(spark: SparkSession, path: str) -> DataFrame:
    """(book, content) of the workbooks under a path; a book is known by its file name alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xls[xm]").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("book"), "content")


def books(spark: SparkSession, path: str) -> DataFrame:
    """(book): a row for each workbook under a path; contents are not read."""
    return _books(spark, path).select("book")


def parts(spark: SparkSession, path: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for book, content in frame.itertuples(index=False):
                found = read_parts(content)
                yield pd.DataFrame({"book": book, "part": list(found), "bytes": list(found.values()), "size": [len(b) for b in found.values()], "sha256": None})

    out = _books(spark, path).mapInPandas(run, PARTS)
    return out.withColumn("sha256", F.sha2("bytes", 256))


def cells(spark: SparkSession, path: str) -> DataFrame:
    """All populated cells of the workbooks under a path."""
    names = [c.split()[0] for c in CELLS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for book, content in frame.itertuples(index=False):
                batch = []
                for cell in cells_of(read_parts(content)):
                    batch.append((book, *cell))
                    if len(batch) == 50_000:
                        yield pd.DataFrame(batch, columns=names).astype({"bool": "object"})
                        batch = []
                yield pd.DataFrame(batch, columns=names).astype({"bool": "object"})

    return _books(spark, path).mapInPandas(run, CELLS)


def sheets(spark: SparkSession, path: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for book, content in frame.itertuples(index=False):
                yield pd.DataFrame([(book, n, i, state, part) for i, (n, part, state) in enumerate(sheets_of(read_parts(content)))], columns=["book", "sheet", "sheet_idx", "state", "part"])

    return _books(spark, path).mapInPandas(run, "book string, sheet string, sheet_idx int, state string, part string")


def defined_names(spark: SparkSession, path: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for book, content in frame.itertuples(index=False):
                yield pd.DataFrame([(book, *d) for d in defined_names_of(read_parts(content))], columns=["book", "name", "refers_to"])

    return _books(spark, path).mapInPandas(run, "book string, name string, refers_to string")
