"""Laws and cases of the coordinate algebra."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import oracle
from cellgrid.operators.shift import Edit, line_of, offset_formula, references, shift_formula, span_of, template
from cellgrid.plans import catalog

POSITIVE = st.integers(1, 200)


@given(POSITIVE, POSITIVE, st.integers(1, 20))
@settings(max_examples=200)
def test_delete_undoes_insert(p, at, n):
    assert line_of(line_of(p, Edit("row", "insert", at, n)), Edit("row", "delete", at, n)) == p


@given(POSITIVE, st.integers(1, 20), POSITIVE)
@settings(max_examples=200)
def test_move_is_a_permutation(at, n, dest):
    edit = Edit("row", "move", at, n, dest)
    top = 260
    assert sorted(line_of(p, edit) for p in range(1, top)) == list(range(1, top))


@given(POSITIVE, st.integers(0, 30), POSITIVE, st.integers(1, 30))
@settings(max_examples=200)
def test_deleting_clamps_a_span_to_what_survives(head, size, at, n):
    edit = Edit("row", "delete", at, n)
    left = [q for q in (line_of(p, edit) for p in range(head, head + size + 1)) if q is not None]
    assert span_of(head, head + size, edit) == ((min(left), max(left)) if left else None)


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("=A1+A10", "=A1+A12"),
        ("=$A$10&\"A10\"", "=$A$12&\"A10\""),
        ("=SUM(A1:A10)", "=SUM(A1:A12)"),
        ("=SUM(5:9)", "=SUM(5:11)"),
        ("=SUM(A:B)", "=SUM(A:B)"),
        ("=Other!A10+[2]S!A10", "=Other!A10+[2]S!A10"),
        ("=S!A10+'S'!A10", "=S!A12+'S'!A12"),
        ("=LOG10(A10)+TAX10X", "=LOG10(A12)+TAX10X"),
        ("=A10:A9", "=A12:A11"),
    ],
)
def test_insert_two_rows_before_eight(formula, want):
    assert shift_formula(formula, Edit("row", "insert", 8, 2, sheet="S"), "S")[0] == want


def test_deleted_reference_is_an_error():
    assert shift_formula("=A5+B9", Edit("row", "delete", 5, 1, sheet="S"), "S") == ("=#REF!+B8", 2)


def test_columns():
    assert shift_formula("=SUM(B2:D2)+XFD1", Edit("col", "insert", 3, 1, sheet="S"), "S")[0] == "=SUM(B2:E2)+#REF!"


def test_filling():
    assert offset_formula("=A1+$A1+A$1+$A$1", 2, 1) == "=B3+$A3+B$1+$A$1"
    assert offset_formula("=A1", -1, 0) == "=#REF!"


def test_a_table_has_no_last_row():
    far = Edit("row", "insert", 8, 5, sheet="S", last_row=None)
    assert shift_formula("=A1048574+SUM(A9:$B$12345678)+9:1048576", far, "S") == ("=A1048579+SUM(A14:$B$12345683)+14:1048581", 3)
    assert shift_formula("=A1048574", Edit("row", "insert", 8, 5, sheet="S"), "S")[0] == "=#REF!"
    assert offset_formula("=A1+B$2", 12345678, 0, last_row=None) == "=A12345679+B$2"
    assert offset_formula("=A1", -1, 0, last_row=None) == offset_formula("=A1", 1048576, 0) == "=#REF!"


@pytest.mark.parametrize("name", ["offset_formula", "shift_formula", "shift_sqref"])
def test_orders_below_the_grid_equal_sql(spark, tmp_path, name):
    keys = [0, 98, 99, 103, 104, 1048569, 1048570, 1048573, 1048575, 1048576, 8999999, 9999999, 123456789012]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert oracle.compare(spark, con, catalog.QUERIES[name], catalog.SQL[name], str(tmp_path)) is None


def test_template_and_references():
    assert template("=A1*B2+A1") == template("=C7*D9+C7") == "=#0*#1+#0"
    assert references("=S!A1+\"B2\"+C3:D4") == [("S!", "A1"), (None, "C3:D4")]
