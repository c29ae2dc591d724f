"""How often two cells hold the same value, and how likely checks are to miss an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.schema import sheet_of


def spans(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*sheet_of(cells), "col").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("cells"))


def adjacent(cells: DataFrame) -> DataFrame:
    """Per column: neighbours down that are both there, and those that are equal."""
    down = Window.partitionBy(*sheet_of(cells), "col").orderBy("row")
    raw = F.struct("kind", "num", "str", "bool", "err")
    pair = cells.withColumn("next_row", F.lead("row").over(down)).withColumn("next", F.lead(raw).over(down)).filter("next_row = row + 1")
    return pair.groupBy(*sheet_of(cells), "col").agg(F.count("*").alias("pairs"), F.count_if(F.col("next").eqNullSafe(raw)).alias("equal"))


def uniform(cells: DataFrame) -> DataFrame:
    """Per column: pairs of cells, and pairs that are equal, counted from value counts and never formed."""
    by_value = cells.groupBy(*sheet_of(cells), "col", "kind", "num", "str", "bool", "err").agg(F.count("*").alias("c"))
    n = F.sum("c")
    return by_value.groupBy(*sheet_of(cells), "col").agg((n * (n - 1) / 2).cast("long").alias("pairs"), F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("equal"))


def rate_summary(rates: DataFrame, x: str = "rate") -> DataFrame:
    """Mean, median, tenth and ninetieth order statistics, and shares at 0 and from 0.99 on."""
    ranked = rates.withColumn("i", F.row_number().over(Window.orderBy(x)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))  # a row a column of a book
    at = lambda p: F.max(F.when(F.col("i") == F.floor(p * (F.col("n") - 1)), F.col(x)))
    return ranked.agg(
        F.avg(x).alias("mean"), F.median(x).alias("median"), at(0.1).alias("p10"), at(0.9).alias("p90"),
        (F.count_if(F.col(x) == 0) / F.count("*")).alias("share_zero"), (F.count_if(F.col(x) >= 0.99) / F.count("*")).alias("share_one"),
    )


def detection(rates: DataFrame, most: int, x: str = "rate") -> DataFrame:
    """For k checks from 1 to `most`: the chance that all miss, from the mean rate and from the mixture of rates."""
    powers = rates.select(F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"), x)
    return powers.groupBy("k").agg(F.pow(F.avg(x), F.col("k")).alias("naive"), F.avg(F.pow(x, F.col("k"))).alias("mixture"))


def hypergeometric_miss(n: Column, bad: Column, k: Column) -> Column:
    """The chance that k draws without replacement from n miss all `bad` ones."""
    steps = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda p, i: p * F.greatest(n - bad - i, F.lit(0)) / (n - i))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct<low, high>: the 95 % interval of a share."""
    p = hits / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(((centre - half) / (1 + z * z / n)).alias("low"), ((centre + half) / (1 + z * z / n)).alias("high"))
