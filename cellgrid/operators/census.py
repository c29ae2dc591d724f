"""What books hold: populated cells, extents, kinds, errors and function calls; sheets of different books are apart where cells have a `book`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.policy import LITERALS
from cellgrid.schema import sheet_of

#: A call: a name right before a parenthesis, outside of quotes.
_CALL = r"([A-Za-z_][A-Za-z0-9_.]*)\("
POLICY_LIMITED = list(LITERALS)
#: Functions whose value changes by itself: fixed values.
NONDETERMINISTIC = "NOW TODAY RAND RANDBETWEEN".split()
VOLATILE = NONDETERMINISTIC + "OFFSET INDIRECT CELL INFO".split()


def sheets(cells: DataFrame) -> DataFrame:
    """Per sheet: cells, formulas, errors and the populated extent (0 where there is none)."""
    return cells.groupBy(*sheet_of(cells)).agg(
        F.count("*").alias("cells"),
        F.count("formula").alias("formulas"),
        F.count("err").alias("errors"),
        F.coalesce(F.max("row"), F.lit(0)).cast("long").alias("max_row"),
        F.coalesce(F.max("col"), F.lit(0)).cast("long").alias("max_col"),
    )


def columns(cells: DataFrame) -> DataFrame:
    """Per sheet and column: populated cells by kind and the rows between which they lie."""
    kinds = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("n", "numbers"), ("s", "texts"), ("b", "booleans"), ("e", "error_cells"))]
    return cells.groupBy(*sheet_of(cells), "col").agg(F.count("*").alias("cells"), *kinds, F.min("row").alias("first_row"), F.max("row").alias("last_row"))


def errors(cells: DataFrame) -> DataFrame:
    """Per sheet a histogram of error literals."""
    return cells.filter("err is not null").groupBy(*sheet_of(cells), "err").agg(F.count("*").alias("n"))


def calls(formulas: DataFrame, formula: str = "formula") -> DataFrame:
    """The frame with a row for each call site and its `name` in upper case; text in quotes holds no calls."""
    bare = F.regexp_replace(F.col(formula), r'"[^"]*"', '""')
    return formulas.withColumn("name", F.explode(F.regexp_extract_all(bare, F.lit(_CALL), 1))).withColumn("name", F.upper(F.regexp_replace("name", r"(?i)^_xlfn\.(_xlws\.)?", "")))


def functions(formulas: DataFrame, formula: str = "formula") -> DataFrame:
    """Call sites per name."""
    return calls(formulas, formula).groupBy("name").agg(F.count("*").alias("sites"))


def classified(functions: DataFrame, catalog: DataFrame, defined_names: DataFrame | None = None) -> DataFrame:
    """Each called name's class: policy_limited, supported, user_defined (by a defined name) or unsupported, in this order."""
    known = catalog.select(F.upper("name").alias("name"), F.lit(True).alias("known")).distinct()
    out = functions.join(F.broadcast(known), "name", "left")  # a catalog has a fixed number of names
    own: Column = F.lit(False)
    if defined_names is not None:
        out = out.join(defined_names.select(F.upper("name").alias("name"), F.lit(True).alias("own")).distinct(), "name", "left")
        own = F.coalesce("own", F.lit(False))
    kind = (
        F.when(F.col("name").isin(POLICY_LIMITED), "policy_limited")
        .when(F.coalesce("known", F.lit(False)), "supported")
        .when(own, "user_defined")
        .otherwise("unsupported")
    )
    return out.select("name", "sites", kind.alias("class"), F.col("name").isin(VOLATILE).alias("volatile"))


def redacted(per_sheet: DataFrame) -> DataFrame:
    """Sheet names replaced by `sheet_N`, N in order of name within the book."""
    from pyspark.sql import Window

    sheet = sheet_of(per_sheet)
    names = per_sheet.select(*sheet).distinct().withColumn("n", F.row_number().over(Window.partitionBy(*sheet[:-1]).orderBy("sheet")))  # a book's sheets are few
    return per_sheet.join(names, sheet).drop("sheet").withColumn("sheet", F.concat(F.lit("sheet_"), "n")).drop("n")


def part_flags(parts: DataFrame, part: str = "part") -> DataFrame:
    """Per book, which kinds of package part there are."""
    starts = {
        "has_vba": "xl/vbaProject", "has_pivot": "xl/pivotCache/", "has_external": "xl/externalLinks/",
        "has_charts": "xl/charts/", "has_comments": "xl/comments", "has_threaded": "xl/threadedComments/",
    }
    return parts.groupBy("book").agg(*(F.bool_or(F.col(part).startswith(p)).alias(n) for n, p in starts.items()), F.count("*").alias("parts"))
