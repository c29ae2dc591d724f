"""Reports over workbooks made in memory."""

import pytest

from cellgrid import commands
from cellgrid.operators.shift import Edit
from cellgrid.sinks.xlsx import edited_book
from cellgrid.sources import xlsx
from test_xlsx import book


def put(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content)
    return str(folder)


def test_inspect(spark, tmp_path):
    path = put(tmp_path / "a", "b.xlsx", edited_book(book(), {("One", 4, 1): (1.0, "=MyUdf(A1)+SUM(A1:A2)+NOW()")}))
    out = commands.inspect(spark, path)
    assert [tuple(r) for r in out["sheets"].collect()] == [("b.xlsx", "One", 7, 3, 1, 4, 2)]
    assert {(r.name, r["class"]) for r in out["functions"].collect()} == {("MYUDF", "unsupported"), ("SUM", "supported"), ("NOW", "supported")}
    hidden = commands.inspect(spark, path, redact=True)
    assert {r.name for r in hidden["functions"].collect()} == {"redacted", "SUM", "NOW"}
    assert "One" not in str(hidden["sheets"].collect()) + str(hidden["columns"].collect())


def test_diff(spark, tmp_path):
    old = put(tmp_path / "a", "b.xlsx", book())
    new = put(tmp_path / "c", "b.xlsx", edited_book(book(), {("One", 1, 1): (2.0, None), ("One", 9, 9): ("x", None), ("One", 2, 1): (2.25, "=A1*3")}))
    out = commands.diff(spark, old, new)
    assert out["summary"] == {"changed": 2, "added": 1, "removed": 0, "cached_value": 0} and not out["truncated"]


def test_books_of_a_folder_stay_apart(spark, tmp_path):
    other = edited_book(book(), {("One", 1, 1): (7.0, None), ("One", 9, 1): (1.0, None)})
    old = put(tmp_path / "a", "x.xlsx", book())
    put(tmp_path / "a", "y.xlsx", other)
    same = commands.diff(spark, old, old)
    assert same["summary"] == {"changed": 0, "added": 0, "removed": 0, "cached_value": 0} and same["sheets"].count() == 0
    new = put(tmp_path / "c", "x.xlsx", book())
    put(tmp_path / "c", "y.xlsx", edited_book(other, {("One", 1, 1): (8.0, None)}))
    put(tmp_path / "c", "z.xlsx", book())
    out = commands.diff(spark, old, new)
    assert [(r.book, r.changed, r.added) for r in out["by_sheet"].collect()] == [("y.xlsx", 1, 0)]
    assert {(r.book, r.change) for r in out["sheets"].collect()} == {("z.xlsx", "added")}
    assert {(r.book, r.sheet, r.cells) for r in commands.inspect(spark, old)["sheets"].collect()} == {("x.xlsx", "One", 6), ("y.xlsx", "One", 7)}
    cells = xlsx.cells(spark, old)
    edit = Edit("row", "insert", 2, 3, sheet="One")
    after = commands.restructured(cells, edit)
    assert commands.certify(cells, after, edit)["verdict"] == "certified"
    swapped = after.replace({"x.xlsx": "y.xlsx", "y.xlsx": "x.xlsx"}, subset=["book"])
    assert commands.certify(cells, swapped, edit)["verdict"] == "refused"


def test_books_of_one_name_are_refused(spark, tmp_path):
    path = put(tmp_path / "a", "b.xlsx", book())
    put(tmp_path / "a" / "more", "b.xlsx", book())
    with pytest.raises(ValueError, match="b.xlsx"):
        commands.diff(spark, path, path)


def test_single_books_are_a_pair_under_any_name(spark, tmp_path):
    old, new = put(tmp_path / "a", "old.xlsx", book()), put(tmp_path / "c", "new.xlsx", edited_book(book(), {("One", 1, 1): (2.0, None)}))
    assert commands.diff(spark, old, new)["summary"] == {"changed": 1, "added": 0, "removed": 0, "cached_value": 0}


def test_certify(spark, tmp_path):
    path = put(tmp_path / "a", "b.xlsx", book())
    cells = xlsx.cells(spark, path)
    edit = Edit("row", "insert", 2, 3, sheet="One")
    after = commands.restructured(cells, edit)
    assert {(r.row, r.formula) for r in after.filter("formula is not null").collect()} == {(5, "=A1*$A$1"), (6, "=A5*$A$1")}
    assert commands.certify(cells, after, edit)["verdict"] == "certified"
    assert commands.certify(cells, after.filter("row < 6"), edit)["removed"] == 2
    from pyspark.sql import functions as F

    arrays = cells.withColumn("f_kind", F.when(F.col("formula").isNotNull(), "array"))
    assert commands.certify(arrays, after, edit)["residuals"] == {"array_formula_present": 2}
