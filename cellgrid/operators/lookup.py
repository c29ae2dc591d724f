"""Lookups, criteria aggregates and relational functions of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact(probes: DataFrame, table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The match that is first by `order` wins; no match gives the error #N/A. Text keys match in any case."""
    text = dict(table.dtypes)[key] == "string"
    fold = F.upper if text else (lambda c: c)
    first = F.min_by(value, order)
    found = table.groupBy(fold(F.col(key)).alias("_key")).agg(first.alias("found"), F.lit(True).alias("_hit"))
    out = probes.join(found, fold(probes[key]) == found["_key"], "left")
    return out.withColumn("err", F.when(F.col("_hit").isNull(), "#N/A")).drop("_key", "_hit")


def as_of(probes: DataFrame, table: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """The value of `table`'s last row at or before each probe: a union and one running window, no range join."""
    a = probes.select("*", F.lit(None).cast(dict(table.dtypes)[value]).alias("_v"), F.lit(1).alias("_probe"))
    same = [table[c] if c in (by, at) else F.lit(None).cast(t).alias(c) for c, t in probes.dtypes]
    b = table.select(*same, F.col(value).alias("_v"), F.lit(0).alias("_probe"))
    order = Window.partitionBy(by).orderBy(at, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("found", F.last("_v", ignorenulls=True).over(order)).filter("_probe = 1").drop("_v", "_probe")


def aggregate_if(keys: DataFrame, facts: DataFrame, on: list[str], condition: Column, **aggregates: Column) -> DataFrame:
    """SUMIFS and its kin: facts are aggregated first, then joined; keys without facts have nulls."""
    own = facts.filter(condition).groupBy(*on).agg(*(a.alias(n) for n, a in aggregates.items()))
    return keys.join(own, on, "left")


def matches_any(criteria: list[dict[str, tuple[str, object]]]) -> Column:
    """Rows of criteria are alternatives, the fields of a row hold together: {field: (operator, value)}."""
    tests = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
    any_of = F.lit(False)
    for row in criteria:
        all_of = F.lit(True)
        for field, (operator, value) in row.items():
            all_of = all_of & getattr(F.col(field), tests[operator])(F.lit(value))
        any_of = any_of | all_of
    return any_of


def d_get(rows: DataFrame, condition: Column, value: str) -> DataFrame:
    """DGET: the one value; #VALUE! without a match and #NUM! with several."""
    n = F.count("*")
    got = rows.filter(condition).agg(n.alias("n"), F.min(value).alias("v"))
    return got.select(F.when(F.col("n") == 1, F.col("v")).alias("value"), F.when(F.col("n") == 0, "#VALUE!").when(F.col("n") > 1, "#NUM!").alias("err"))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """MMULT of (i, j, x) and (i, j, x): a join on the inner index and a sum."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("x").alias("p")), b.select(F.col("i").alias("k"), "j", F.col("x").alias("q"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("x"))


def type_rank(kind: Column) -> Column:
    """Number, text, boolean, error; blanks last."""
    return F.when(kind == "n", 1).when(kind == "s", 2).when(kind == "b", 3).when(kind == "e", 4).otherwise(5)


def sort_order(descending: bool = False) -> list[Column]:
    """Ordering of tagged values: by type, then value in any case; blanks last in both directions."""
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    blank = F.when(F.col("kind").isNull(), 1).otherwise(0)
    return [blank.asc(), turn(type_rank(F.col("kind"))), turn(F.col("num")), turn(F.upper("str")), turn(F.col("bool")), turn(F.col("err"))]
