"""Formulas compiled to columns, against results known from their definition."""

import pytest

from cellgrid.formula.compiler import evaluate, parse

CASES = [
    ("=1+2*3", 7.0), ("=(1+2)*3", 9.0), ("=-2^2", 4.0), ("=2^3^2", 64.0), ("=10%*50", 5.0), ("=A1/B1", "#DIV/0!"), ("=A1+Z1", 6.0), ("=C1&A1", "Hi6"), ("=C1=\"hI\"", True), ("=\"a\"<\"B\"", True),
    ("=1<\"a\"", True), ("=A1>5", True), ("=IF(A1>5,\"yes\",\"no\")", "yes"), ("=IF(B1=0,A1,1/0)", 6.0), ("=IFERROR(A1/B1,-1)", -1.0), ("=SQRT(-1)", "#NUM!"), ("=ROUND(2.5,0)", 3.0), ("=ROUND(-2.5,0)", -3.0),
    ("=MOD(-3,2)", 1.0), ("=MOD(1,0)", "#DIV/0!"), ("=INT(-1.5)", -2.0), ("=SUM(A1,B1,D1,C1)", 6.0), ("=AVERAGE(C1)", "#DIV/0!"), ("=COUNT(A1,B1,D1)", 2.0), ("=MAX(A1,9)", 9.0), ("=LEN(C1)+1", 3.0), ("=UPPER(C1)&\"!\"", "HI!"),
    ("=NOT(B1)", True), ("=AND(A1,1)", True), ("=\"x\"+1", "#VALUE!"), ("=\"2\"+1", 3.0), ("=#N/A+1", "#N/A"), ("=NOPE(1)", "#NAME?"), ("=0^0", "#NUM!"), ("=LEFT(C1,1)", "H"), ("=FIND(\"z\",C1)", "#VALUE!"), ("=ISERROR(A1/B1)", True), ("=PI()>3", True), ("=TRUE+1", 2.0),
]


CASES += [
    ("=ISTEXT(C1)", True), ("=ISTEXT(A1)", False), ("=ISTEXT(D1)", False), ("=ISNONTEXT(A1/B1)", True), ("=ISNONTEXT(C1)", False), ("=ISLOGICAL(A1>1)", True), ("=ISLOGICAL(1)", False), ("=ISNUMBER(C1)", False), ("=ISNUMBER(A1/B1)", False),
    ("=ISNUMBER(A1)", True), ("=ISBLANK(Z1)", True), ("=ISBLANK(A1/B1)", False), ("=ISERR(A1/B1)", True), ("=ISERR(NA())", False), ("=ISNA(NA())", True), ("=NA()", "#N/A"), ("=TYPE(C1)", 2.0), ("=TYPE(A1/B1)", 16.0), ("=TYPE(Z1)", 1.0),
    ("=TYPE(TRUE)", 4.0), ("=ERROR.TYPE(A1/B1)", 2.0), ("=ERROR.TYPE(NA())", 7.0), ("=ERROR.TYPE(1)", "#N/A"), ("=IF(ISTEXT(C1),\"t\",\"n\")", "t"),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(6.0, 0.0, "Hi", None, None)], "a double, b double, c string, d double, z double")


@pytest.mark.parametrize(("formula", "want"), CASES)
def test_value(frame, formula, want):
    r = evaluate(frame, formula, {"A1": "a", "B1": "b", "C1": "c", "D1": "d", "Z1": "z"}).first()
    got = r.value if r.value_err is None else r.value_err
    assert got == want


@pytest.mark.parametrize("formula", ["=1+", "=(1", "=IF(1,2", "=1 2", "=,"])
def test_broken_formulas_are_refused(formula):
    with pytest.raises(ValueError):
        parse(formula)


def test_a_column_of_copies_is_one_projection(frame):
    plan = evaluate(frame, "=IF(A1>1,ROUND(A1*2,1),0)", {"A1": "a"})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
