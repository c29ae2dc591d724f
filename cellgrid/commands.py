"""Whole reports over workbooks: inspect, diff, restructure, certify, log and verify.

Each gives DataFrames; the driver sees only counts and capped samples.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.operators import census, diff as differ, journal, shift
from cellgrid.sources import xlsx


def inspect(spark: SparkSession, path: str, redact: bool = False) -> dict[str, DataFrame]:
    """Sheets, columns, errors, functions by class, part flags and digests of the workbooks under a path. No cell's value is shown."""
    from cellgrid.functions.registry import supported

    cells = xlsx.cells(spark, path)
    parts = xlsx.parts(spark, path)
    names = xlsx.defined_names(spark, path)
    catalog = spark.createDataFrame([(n,) for n in supported()], "name string")
    formulas = cells.filter("formula is not null").select("formula").unionByName(names.select(F.col("refers_to").alias("formula")))
    called = census.classified(census.functions(formulas), catalog, names.select("name"))
    by_sheet = census.sheets(cells)
    if redact:
        by_sheet = census.redacted(by_sheet)
        hidden = F.when(F.col("class").isin("user_defined", "unsupported"), "redacted").otherwise(F.col("name"))
        called = called.withColumn("name", hidden).groupBy("name", "class", "volatile").agg(F.sum("sites").alias("sites"))
    return {
        "sheets": by_sheet,
        "columns": census.columns(cells) if not redact else census.redacted(census.columns(cells)),
        "errors": census.errors(cells) if not redact else census.errors(cells).groupBy("err").agg(F.sum("n").alias("n")),
        "functions": called,
        "flags": census.part_flags(parts),
        "parts": parts.select("book", "part", "size", "sha256"),
    }


def diff(spark: SparkSession, old: str, new: str) -> dict:
    """What differs between two workbooks, or two folders of them: totals, totals by sheet, sheets of one side, and the first changes.

    Books are paired by file name; where each side has a single book they are a pair whatever their names.
    """
    a, b = (xlsx.cells(spark, p) for p in (old, new))
    if all(_single(xlsx.books(spark, p)) for p in (old, new)):
        a, b = a.drop("book"), b.drop("book")
    found = differ.changes(a, b)
    totals = differ.summary(found).first().asDict()
    return {
        "summary": totals,
        "by_sheet": differ.summary(found, by_sheet=True),
        "sheets": differ.sheet_changes(a, b),
        "changes": differ.capped(found),
        "truncated": sum(totals.values()) > differ.CAP,
    }


def _single(books: DataFrame) -> bool:
    """Whether there is one book; names that two books share are an error, as nothing would tell their cells apart."""
    twice = books.groupBy("book").agg(F.count("*").alias("n")).filter("n > 1").first()
    if twice:
        raise ValueError(f"{twice.n} books are named {twice.book}")
    return len(books.limit(2).collect()) == 1


def restructured(cells: DataFrame, edit: shift.Edit) -> DataFrame:
    """All cells of a book after a structural edit of `edit.sheet`: moved there, with references to it rewritten everywhere.

    Cells in a deleted band go, on both axes. Formulas are rewritten in Arrow batches, one pass.
    """
    moved = shift.cells(cells, edit)
    rewrite = _rewriter(edit)
    return moved.withColumn("formula", F.when(F.col("formula").isNotNull(), rewrite("formula", "sheet")))


def _rewriter(edit: shift.Edit):
    @F.pandas_udf("string")
    def run(texts: pd.Series, hosts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else shift.shift_formula(t, edit, h)[0] for t, h in zip(texts, hosts, strict=True)])

    return run


def certify(original: DataFrame, edited: DataFrame, edit: shift.Edit) -> dict:
    """Whether `edited` is `original` after `edit` and nothing else; residuals refuse before cells are compared."""
    refused = shift.residuals(original, edit)
    reasons = {r.reason: r.n for r in refused.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    if reasons:
        return {"verdict": "refused", "residuals": reasons}
    expected = restructured(original, edit)
    counts = differ.certified(expected, edited).first().asDict()
    return counts | {"samples": differ.samples(expected, edited)}


def verify(receipts: DataFrame, current: DataFrame | None = None) -> dict[str, DataFrame]:
    """A journal's links, its breaks, heads and, given current hashes (book, hash), the state of each book."""
    out = {"log": journal.links(receipts), "breaks": journal.breaks(receipts), "head": journal.head(receipts)}
    return out | ({"status": journal.status(receipts, current)} if current is not None else {})
