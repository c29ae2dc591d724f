"""AGGREGATE, GROUPBY and PIVOTBY over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order_statistic(x: str, p: float, exclusive: bool) -> Column:
    """Interpolated percentile; the exclusive form is null outside 1/(n+1) .. n/(n+1)."""
    if not exclusive:
        return F.percentile(x, p)
    ordered, n = F.array_sort(F.collect_list(x)), F.count(x)
    at = p * (n + 1)
    low = F.floor(at)
    a, b = F.try_element_at(ordered, low.cast("int")), F.try_element_at(ordered, F.least(low + 1, n).cast("int"))
    return F.when((low >= 1) & (at <= n), a + (at - low) * (b - a))


def aggregate(code: int, x: str, k: float | None = None) -> Column:
    """The function with AGGREGATE's number over column `x`."""
    plain = {
        1: F.avg, 2: F.count, 3: F.count, 4: F.max, 5: F.min, 6: F.product, 7: F.stddev_samp, 8: F.stddev_pop, 9: F.sum,
        10: F.var_samp, 11: F.var_pop, 12: F.median,
    }
    if code in plain:
        return plain[code](x)
    if code == 13:
        return F.mode(x, True)  # of equal counts the least
    if code == 14:
        return F.try_element_at(F.sort_array(F.collect_list(x), asc=False), F.lit(int(k)))
    if code == 15:
        return F.try_element_at(F.sort_array(F.collect_list(x)), F.lit(int(k)))
    if code in (16, 17):
        return _order_statistic(x, k if code == 16 else k / 4, False)
    if code in (18, 19):
        return _order_statistic(x, k if code == 18 else k / 4, True)
    raise ValueError(f"no aggregate {code}")


def kth(frame: DataFrame, by: list[str], x: str, k: int, largest: bool = True) -> DataFrame:
    """LARGE or SMALL of each group as a ranked top-k, so that a group of any size needs k rows a task."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(F.desc(x) if largest else F.asc(x))
    ranked = frame.select(*by, x).filter(F.col(x).isNotNull()).withColumn("_k", F.row_number().over(order)).filter(f"_k <= {k}")
    return ranked.filter(f"_k = {k}").drop("_k")


def visible(frame: DataFrame, options: int, hidden: str = "hidden", error: str = "err", nested: str = "nested") -> DataFrame:
    """The rows that AGGREGATE's option bits leave: odd skips hidden rows, 2 and 3 or 6 and 7 errors, below 4 nested totals."""
    keep = F.lit(True)
    if options % 2:
        keep &= ~F.col(hidden)
    if options & 2:
        keep &= F.col(error).isNull()
    if options < 4:
        keep &= ~F.col(nested)
    return frame.filter(keep)


#: The aggregates that GROUPBY knows by name; empty results have these errors or values.
ETA = {
    "SUM": F.sum, "AVERAGE": F.avg, "COUNT": F.count, "COUNTA": F.count, "MAX": F.max, "MIN": F.min, "MEDIAN": F.median, "PRODUCT": F.product,
    "STDEV.S": F.stddev_samp, "STDEV.P": F.stddev_pop, "VAR.S": F.var_samp, "VAR.P": F.var_pop,
}


def folded(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `_f0`, `_f1`...: keys as they group: text in any case, -0 as 0."""
    kinds = dict(frame.dtypes)
    fold = lambda c: F.upper(c) if kinds[c] == "string" else F.when(F.col(c) == 0, F.lit(0).cast(kinds[c])).otherwise(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
    return frame.withColumns({f"_f{i}": fold(k) for i, k in enumerate(keys)})


def group_by(frame: DataFrame, keys: list[str], value: str, function: str = "SUM", depth: int = 1, keep: Column | None = None) -> DataFrame:
    """GROUPBY: one row a group, and totals down to `depth` levels (1: the grand total; 2: also of the first key, and so on).

    Groups form in any case and show the least spelling. Columns: keys, value, level (how many keys the row is a total over: 0 a group).
    A rollup computes groups and totals in one pass over the input.
    """
    if keep is not None:
        frame = frame.filter(keep)
    n = len(keys)
    depth = max(0, min(abs(depth), n))
    shown = [F.min(k).alias(k) for k in keys]
    if function == "PERCENTOF":
        grand = frame.agg(F.sum(value).alias("_grand"))  # one row
        out = group_by(frame, keys, value, "SUM", n).crossJoin(F.broadcast(grand))
        out = out.withColumn("value", F.col("value") / F.col("_grand")).drop("_grand")
        return out.filter(F.col("level").isin(0, *range(n - depth + 1, n + 1)))
    own = folded(frame, keys)
    total = own.rollup(*(f"_f{i}" for i in range(n))).agg(F.grouping_id().alias("_g"), *shown, ETA[function](value).alias("value"))
    level = reduce(lambda c, k: F.when(F.col("_g") == (1 << k) - 1, k) if c is None else c.when(F.col("_g") == (1 << k) - 1, k), range(n + 1), None)
    total = total.withColumn("level", level).filter(F.col("level").isin(0, *range(n - depth + 1, n + 1)))
    labels = [
        F.when(F.col("level") == 0, F.col(k).cast("string"))
        .when(F.col("level") == n, F.lit("Total") if i == 0 else F.lit(""))
        .when(F.lit(i) < n - F.col("level") - 1, F.col(k).cast("string"))
        .when(F.lit(i) == n - F.col("level") - 1, F.concat(F.col(k).cast("string"), F.lit(" Total")))
        .otherwise("")
        .alias(k)
        for i, k in enumerate(keys)
    ]
    return total.select(*labels, "value", F.col("level").cast("int").alias("level"))


def pivot_by(frame: DataFrame, rows: list[str], column: str, value: str, function: str = "SUM", values: list | None = None, totals: bool = True) -> DataFrame:
    """PIVOTBY with a grand total column and row; `values`: the column keys, where they are known."""
    cells = frame.groupBy(*rows).pivot(column, values).agg(ETA[function](value))
    if not totals:
        return cells
    by_row = frame.groupBy(*rows).agg(ETA[function](value).alias("Total"))
    body = cells.join(by_row, rows)
    foot = frame.groupBy().pivot(column, values).agg(ETA[function](value)).crossJoin(frame.agg(ETA[function](value).alias("Total")))  # one row and one row
    names = [F.lit("Total" if i == 0 else "").alias(r) for i, r in enumerate(rows)]
    return body.select(*(F.col(r).cast("string").alias(r) for r in rows), *body.columns[len(rows) :]).unionByName(foot.select(*names, *foot.columns))


def shares(frame: DataFrame, row: str, column: str, value: str, relative_to: int) -> DataFrame:
    """PERCENTOF in a pivot's long form: relative to 0 column totals, 1 row totals, 2 the grand total."""
    from pyspark.sql import Window

    cells = frame.groupBy(row, column).agg(F.sum(value).alias("v"))
    if relative_to == 2:
        grand = frame.agg(F.sum(value).alias("_grand"))  # one row
        return cells.crossJoin(F.broadcast(grand)).select(row, column, (F.col("v") / F.col("_grand")).alias("share"))
    part = {0: Window.partitionBy(column), 1: Window.partitionBy(row)}[relative_to]
    return cells.select(row, column, (F.col("v") / F.sum("v").over(part)).alias("share"))
