"""Grids made from the test tables: two snapshots of the orders, formulas, receipts, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.plans.tables import table
from cellgrid.schema import CELL_COLUMNS, cells

#: SQL of the same two snapshots of the orders: (sheet, row, col, kind, num, str, formula, formatted).
SNAPSHOT_SQL = """
base AS (SELECT o_orderkey k, o_orderkey + 2 AS r, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders),
old_cells AS (
  SELECT 'orders' sheet, r, 1 col, 'n' kind, CAST(o_custkey AS DOUBLE) num, CAST(NULL AS VARCHAR) str, CAST(NULL AS VARCHAR) formula, CAST(NULL AS VARCHAR) formatted FROM base
  UNION ALL SELECT 'orders', r, 2, 's', NULL, o_orderstatus, NULL, NULL FROM base
  UNION ALL SELECT 'orders', r, 3, 'n', o_totalprice, NULL, NULL, CASE WHEN k % 79 = 0 THEN 'plain' END FROM base
  UNION ALL SELECT 'orders', r, 4, 'n', o_totalprice * 2, NULL, concat('=C', r, '*2'), NULL FROM base
  UNION ALL SELECT 'gone', r, 1, 'n', CAST(k AS DOUBLE), NULL, NULL, NULL FROM base WHERE k % 500 = 0),
new_cells AS (
  SELECT 'orders' sheet, r, 1 col, 'n' kind, CAST(o_custkey AS DOUBLE) num, CAST(NULL AS VARCHAR) str, CAST(NULL AS VARCHAR) formula, CAST(NULL AS VARCHAR) formatted FROM base WHERE k % 101 <> 0
  UNION ALL SELECT 'orders', r, 2, 's', NULL, CASE WHEN k % 97 = 0 THEN concat(o_orderstatus, '!') ELSE o_orderstatus END, NULL, NULL FROM base
  UNION ALL SELECT 'orders', r, 3, 'n', o_totalprice, NULL, NULL, CASE WHEN k % 79 = 0 THEN 'bold' END FROM base
  UNION ALL SELECT 'orders', r, 4, 'n', CASE WHEN k % 83 = 0 THEN o_totalprice ELSE o_totalprice * 2 END, NULL, CASE WHEN k % 89 = 0 THEN concat('=C', r, '+C', r) ELSE concat('=C', r, '*2') END, NULL FROM base
  UNION ALL SELECT 'orders', r, 5, 'n', CAST(k AS DOUBLE), NULL, NULL, NULL FROM base WHERE k % 103 = 0
  UNION ALL SELECT 'fresh', r, 1, 'n', CAST(k AS DOUBLE), NULL, NULL, NULL FROM base WHERE k % 400 = 0),
joined AS (
  SELECT coalesce(o.sheet, n.sheet) sheet, coalesce(o.r, n.r) AS row, coalesce(o.col, n.col) col,
    CASE WHEN o.sheet IS NULL THEN 'added' WHEN n.sheet IS NULL THEN 'removed'
      WHEN o.formula IS DISTINCT FROM n.formula THEN 'formula'
      WHEN o.formula IS NOT NULL AND (o.num IS DISTINCT FROM n.num OR o.str IS DISTINCT FROM n.str) THEN 'cached_value'
      WHEN o.formula IS NULL AND (o.num IS DISTINCT FROM n.num OR o.str IS DISTINCT FROM n.str) THEN 'value'
      WHEN o.formula IS NULL AND o.formatted IS DISTINCT FROM n.formatted THEN 'format' END AS change
  FROM old_cells o FULL JOIN new_cells n ON o.sheet = n.sheet AND o.r = n.r AND o.col = n.col)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new): the orders as cells before and after edits that depend on the key."""
    orders = table(spark, sf_dir, "orders")
    k, row, price = F.col("o_orderkey"), (F.col("o_orderkey") + 2), F.col("o_totalprice")

    def cell(col: int, kind: str, value, formula=None, formatted=None, when=None):
        null = lambda t: F.lit(None).cast(t)
        fields = {
            "col": F.lit(col), "kind": F.lit(kind), "num": value.cast("double") if kind == "n" else null("double"), "str": value if kind == "s" else null("string"),
            "bool": null("boolean"), "err": null("string"), "formula": null("string") if formula is None else formula, "formatted": null("string") if formatted is None else formatted,
        }
        one = F.struct(*(v.alias(n) for n, v in fields.items()))
        return one if when is None else F.when(when, one)

    def book(sheet: str, *made):
        found = orders.select(row.alias("row"), F.explode(F.array_compact(F.array(*made))).alias("c"))
        return found.select(F.lit(sheet).alias("sheet"), "row", "c.*").select(*CELL_COLUMNS)

    double = F.concat(F.lit("=C"), row, F.lit("*2"))
    old = book(
        "orders",
        cell(1, "n", F.col("o_custkey")),
        cell(2, "s", F.col("o_orderstatus")),
        cell(3, "n", price, formatted=F.when(k % 79 == 0, "plain")),
        cell(4, "n", price * 2, formula=double),
    ).unionByName(book("gone", cell(1, "n", k, when=k % 500 == 0)))
    new = book(
        "orders",
        cell(1, "n", F.col("o_custkey"), when=k % 101 != 0),
        cell(2, "s", F.when(k % 97 == 0, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus"))),
        cell(3, "n", price, formatted=F.when(k % 79 == 0, "bold")),
        cell(4, "n", F.when(k % 83 == 0, price).otherwise(price * 2), formula=F.when(k % 89 == 0, F.concat(F.lit("=C"), row, F.lit("+C"), row)).otherwise(double)),
        cell(5, "n", k, when=k % 103 == 0),
    ).unionByName(book("fresh", cell(1, "n", k, when=k % 400 == 0)))
    return old, new


def table_cells(spark: SparkSession, sf_dir: str, name: str, key: str, columns: list[str] | None = None) -> DataFrame:
    """A table with a dense key as cells: the header is row 1, key k is row k + 2."""
    return cells(table(spark, sf_dir, name), F.col(key) + 2, name, columns)


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal per user; every hundredth one starts from a hash that nothing made."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_id")
    made = lambda e: F.concat(F.lit("h"), e.cast("string"))
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("book"), F.col("event_id").alias("line_no"), F.row_number().over(order).alias("rev"),
        F.lag("event_id").over(order).alias("before"), "event_id",
    )
    base = F.when(F.col("event_id") % 100 == 0, F.lit("lost")).otherwise(F.coalesce(made(F.col("before")), F.lit("h")))
    return events.select("book", "line_no", F.col("rev").cast("long").alias("rev"), base.alias("base_hash"), made(F.col("event_id")).alias("result_hash"))


RECEIPTS_SQL = """
receipts AS (SELECT user_id AS book, event_id AS line_no, row_number() OVER w AS rev,
  CASE WHEN event_id % 100 = 0 THEN 'lost' ELSE CASE WHEN lag(event_id) OVER w IS NULL THEN 'h' ELSE concat('h', lag(event_id) OVER w) END END AS base_hash, concat('h', event_id) AS result_hash
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
"""
