"""Small cases of the relational operators."""

from pyspark.sql import functions as F

from cellgrid import a1
from cellgrid.operators import census, diff, graph, journal, lookup
from cellgrid.schema import CELL_COLUMNS

_SCHEMA = "sheet string, row long, col int, kind string, num double, str string, bool boolean, err string, formula string, formatted string"


def book(spark, *rows):
    return spark.createDataFrame([(s, r, c, k, n, t, None, None, f, fm) for s, r, c, k, n, t, f, fm in rows], _SCHEMA).select(*CELL_COLUMNS)


def test_kinds_of_change(spark):
    old = book(
        spark, ("S", 1, 1, "n", 1.0, None, None, None), ("S", 2, 1, "n", 1.0, None, "=A1", "1"), ("S", 3, 1, "n", 1.0, None, "=A1", "1"), ("S", 4, 1, "n", 1.0, None, None, "1"),
        ("S", 5, 1, "n", 1.0, None, None, None), ("S", 6, 1, "n", 1.0, None, "=A1", "1"), ("S", 8, 1, "n", float("nan"), None, None, None), ("Old", 1, 1, "n", 1.0, None, None, None),
    )
    new = book(
        spark, ("S", 1, 1, "s", None, "1", None, None), ("S", 2, 1, "n", 1.0, None, "=A2", "1"), ("S", 3, 1, "n", 2.0, None, "=A1", "2"), ("S", 4, 1, "n", 1.0, None, None, "1.0"),
        ("S", 7, 1, "n", 1.0, None, None, None), ("S", 6, 1, "n", 1.0, None, "=A1", "1.0"), ("S", 8, 1, "n", float("nan"), None, None, None),
    )
    found = {(r.row, r.change) for r in diff.changes(old, new).collect()}
    assert found == {(1, "value"), (2, "formula"), (3, "cached_value"), (4, "format"), (5, "removed"), (7, "added")}
    assert [tuple(r) for r in diff.sheet_changes(old, new).collect()] == [("Old", 1, "removed")]
    assert diff.certified(old, old).first().verdict == "certified"
    assert diff.certified(old, new).first().removed == 2


def test_summary_of_nothing_is_zeros(spark):
    empty = book(spark).limit(0)
    assert tuple(diff.summary(diff.changes(empty, empty)).first()) == (0, 0, 0, 0)


def test_calls_ignore_quotes_and_prefixes(spark):
    f = spark.createDataFrame([('=SUM(A1)&"MAX(1)"&_xlfn.XLOOKUP(1)',)], "formula string")
    assert sorted(r.name for r in census.calls(f).collect()) == ["SUM", "XLOOKUP"]


def test_labels(spark):
    df = spark.createDataFrame([(1, 1), (5, 26), (7, 27), (9, 702), (2, 703), (1048576, 16384), (1, 16385), (0, 1)], "r int, c int")
    got = [r[0] for r in df.select(a1.label(F.col("r"), F.col("c"))).collect()]
    assert got == ["A1", "Z5", "AA7", "ZZ9", "AAA2", "XFD1048576", "R1C16385", "R0C1"]
    texts = spark.createDataFrame([("B7",), ("$B$7",), ("A0",), ("XFE1",), ("A1048577",), ("xfd1",)], "t string")
    assert [None if r[0] is None else tuple(r[0]) for r in texts.select(a1.parse(F.col("t"))).collect()] == [(7, 2), None, None, None, None, (1, 16384)]


def test_journal(spark):
    r = spark.createDataFrame([("b", 1, 1, "x", "h1"), ("b", 2, 2, "h1", "h2"), ("b", 3, 4, "h2", "h3"), ("b", 4, 4, "h3", "h4"), ("b", 5, 5, "zz", "h5")], "book string, line_no long, rev long, base_hash string, result_hash string")
    assert [x.linked for x in journal.links(r).orderBy("line_no").collect()] == [True, True, True, False, False]
    assert journal.head(r).first().result_hash == "h5"
    assert journal.undo_target(r.filter("line_no < 4")).first().rev == 2
    now = spark.createDataFrame([("b", "h5"), ("c", "q")], "book string, hash string")
    assert {tuple(x) for x in journal.status(r, now).collect()} == {("b", "ok"), ("c", "genesis")}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {r.node for r in graph.closure(edges, seeds).collect()} == {1, 2, 3}


def test_sort_puts_blanks_last_both_ways(spark):
    df = spark.createDataFrame([("n", 2.0, None), ("s", None, "b"), (None, None, None), ("n", 1.0, None), ("s", None, "A")], "kind string, num double, str string").withColumns({"bool": F.lit(None).cast("boolean"), "err": F.lit(None).cast("string")})
    up = [(r.num, r.str) for r in df.orderBy(*lookup.sort_order()).collect()]
    down = [(r.num, r.str) for r in df.orderBy(*lookup.sort_order(True)).collect()]
    assert up == [(1.0, None), (2.0, None), (None, "A"), (None, "b"), (None, None)]
    assert down == [(None, "b"), (None, "A"), (2.0, None), (1.0, None), (None, None)]


def test_models_run_in_order():
    assert graph.in_order({"c": {"b"}, "b": {"a"}, "a": set()}) == ["a", "b", "c"]
    try:
        graph.in_order({"a": {"b"}, "b": {"a"}})
    except ValueError as e:
        assert "cycle" in str(e)
    else:
        raise AssertionError
