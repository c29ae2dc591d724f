"""Queries of the relational surface: aggregates, groupings, lookups, ranks, sorting and function families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellgrid.functions.registry import FUNCTIONS as X
from cellgrid.operators import aggregate, lookup
from cellgrid.plans.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


def _money(c: str):
    return F.col(c).cast("decimal(18,2)")


_AGG_SQL = {
    1: "round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6)", 2: "count(l_quantity)", 3: "count(l_quantity)", 4: "max(l_quantity)", 5: "min(l_quantity)",
    6: "round(exp(sum(ln(1 + l_discount))), 6)", 7: "round(stddev_samp(l_quantity), 6)", 8: "round(stddev_pop(l_quantity), 6)", 9: "CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)",
    10: "round(var_samp(l_quantity), 6)", 11: "round(var_pop(l_quantity), 6)", 12: "median(l_quantity)", 16: "round(quantile_cont(l_extendedprice, CAST(0.35 AS DOUBLE)), 6)", 17: "round(quantile_cont(l_extendedprice, CAST(0.25 AS DOUBLE)), 6)",
}


def _agg(code: int):
    def run(spark, sf_dir):
        lines = table(spark, sf_dir, "lineitem")
        k = {16: 0.35, 17: 1}.get(code)
        x = "l_extendedprice" if code in (16, 17) else "l_quantity"
        v = aggregate.aggregate(code, x, k)
        return lines.groupBy("l_returnflag").agg((v if code in (2, 3, 4, 5, 9, 12) else F.round(v, 6)).alias("v"))

    return run


for _code, _sql in _AGG_SQL.items():
    if _code != 6:  # a product over all lines is not finite: by order, below
        query(f"SELECT l_returnflag, {_sql} v FROM lineitem GROUP BY 1", f"agg_{_code:02d}")(_agg(_code))


@query("SELECT l_orderkey, round(exp(sum(ln(1 + l_discount))), 6) v FROM lineitem GROUP BY 1")
def agg_06(spark, sf_dir):
    """PRODUCT over all lines; an order's product stays finite."""
    lines = table(spark, sf_dir, "lineitem").withColumn("f", 1 + F.col("l_discount"))
    return lines.groupBy("l_orderkey").agg(F.round(aggregate.aggregate(6, "f"), 6).alias("v"))


@query("SELECT l_returnflag, mode v FROM (SELECT l_returnflag, l_quantity AS mode, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def agg_13(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(aggregate.aggregate(13, "l_quantity").alias("v"))


@query("SELECT l_returnflag, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) = 5")
def agg_14(spark, sf_dir):
    return aggregate.kth(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 5)


@query("SELECT l_returnflag, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) = 5")
def agg_15(spark, sf_dir):
    return aggregate.kth(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 5, largest=False)


def _exclusive_sql(p: float) -> str:
    return (
        "WITH a AS (SELECT c_mktsegment g, list(c_acctbal ORDER BY c_acctbal) l, count(*) n FROM customer GROUP BY 1), b AS (SELECT g, l, n, "
        f"CAST({p} AS DOUBLE) * (n + 1) AS pos FROM a) SELECT g, round(CASE WHEN pos >= 1 AND pos <= n THEN l[CAST(floor(pos) AS BIGINT)] + (pos - floor(pos)) * (l[least(CAST(floor(pos) AS BIGINT) + 1, n)] - l[CAST(floor(pos) AS BIGINT)]) END, 6) v FROM b"
    )


def _exclusive(code: int, k: float):
    return lambda spark, sf_dir: table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("g")).agg(F.round(aggregate.aggregate(code, "c_acctbal", k), 6).alias("v"))


query(_exclusive_sql(0.35), "agg_18")(_exclusive(18, 0.35))
query(_exclusive_sql(0.75), "agg_19")(_exclusive(19, 3))

_OPTION = "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) v FROM lineitem WHERE {} GROUP BY 1"


def _flagged(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumns(
        {"hidden": F.col("l_linenumber") == 2, "err": F.when(F.col("l_linenumber") == 3, "#N/A"), "nested": F.col("l_linenumber") == 4}
    )


@query(_OPTION.format("l_linenumber NOT IN (2, 4)"))
def agg_ignore_hidden(spark, sf_dir):
    return aggregate.visible(_flagged(spark, sf_dir), 1).groupBy("l_returnflag").agg(F.sum(_money("l_quantity")).cast("double").alias("v"))


@query(_OPTION.format("l_linenumber <> 3"))
def agg_ignore_errors(spark, sf_dir):
    return aggregate.visible(_flagged(spark, sf_dir), 6).groupBy("l_returnflag").agg(F.sum(_money("l_quantity")).cast("double").alias("v"))


@query(_OPTION.format("l_linenumber <> 4"))
def subtotal_nested(spark, sf_dir):
    return aggregate.visible(_flagged(spark, sf_dir), 0).groupBy("l_returnflag").agg(F.sum(_money("l_quantity")).cast("double").alias("v"))


_CNR = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _cnr(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    both = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return both.select("c_mktsegment", "n_name", "r_name", _money("c_acctbal").alias("bal"))


def _double(df, c="value"):
    return df.withColumn(c, F.col(c).cast("double"))


@query(f"SELECT r_name, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS value, 0 AS level FROM {_CNR} GROUP BY 1")
def groupby_sum(spark, sf_dir):
    return _double(aggregate.group_by(_cnr(spark, sf_dir), ["r_name"], "bal", depth=0))


@query(f"SELECT r_name, c_mktsegment, count(*) AS value, 0 AS level FROM {_CNR} GROUP BY 1, 2")
def groupby_multi(spark, sf_dir):
    return aggregate.group_by(_cnr(spark, sf_dir), ["r_name", "c_mktsegment"], "bal", "COUNT", depth=0)


@query(
    "WITH t AS (SELECT r_name, c_mktsegment, grouping(r_name, c_mktsegment) g, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS value "
    f"FROM {_CNR} GROUP BY ROLLUP (r_name, c_mktsegment)) SELECT CASE g WHEN 0 THEN r_name WHEN 1 THEN concat(r_name, ' Total') ELSE 'Total' END AS r_name, "
    "CASE g WHEN 0 THEN c_mktsegment ELSE '' END AS c_mktsegment, value, CASE g WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level FROM t"
)
def groupby_totals_top(spark, sf_dir):
    return _double(aggregate.group_by(_cnr(spark, sf_dir), ["r_name", "c_mktsegment"], "bal", depth=-2))


@query(
    "SELECT n_name, CAST(s AS DOUBLE) AS value, 0 AS level, row_number() OVER (ORDER BY s DESC, n_name) AS place "
    f"FROM (SELECT n_name, sum(CAST(c_acctbal AS DECIMAL(18,2))) s FROM {_CNR} GROUP BY 1)"
)
def groupby_sorted(spark, sf_dir):
    """All groups with their place: sorted by the aggregate, ties by key."""
    place = F.row_number().over(Window.orderBy(F.desc("value"), "n_name"))  # over the groups
    return _double(aggregate.group_by(_cnr(spark, sf_dir), ["n_name"], "bal", depth=0)).withColumn("place", place.cast("long"))


@query(f"SELECT r_name, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS value, 0 AS level FROM {_CNR} WHERE c_acctbal > 0 GROUP BY 1")
def groupby_filter(spark, sf_dir):
    return _double(aggregate.group_by(_cnr(spark, sf_dir), ["r_name"], "bal", depth=0, keep=F.col("bal") > 0))


@query(
    f"WITH t AS (SELECT r_name, sum(CAST(c_acctbal AS DECIMAL(18,2))) s FROM {_CNR} GROUP BY 1) "
    "SELECT r_name, round(CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE), 6) AS value, 0 AS level FROM t UNION ALL SELECT 'Total', 1.0, 1"
)
def groupby_percentof(spark, sf_dir):
    base = _cnr(spark, sf_dir).withColumn("bal", F.col("bal").cast("double"))
    return aggregate.group_by(base, ["r_name"], "bal", "PERCENTOF").withColumn("value", F.round("value", 6))


_YEARS = list(range(1995, 2002))


@query(
    "WITH o AS (SELECT o_orderpriority p, year(o_orderdate) y, CAST(o_totalprice AS DECIMAL(18,2)) v FROM orders) "
    + "SELECT CASE WHEN grouping(p) = 1 THEN 'Total' ELSE p END AS o_orderpriority, "
    + ", ".join(f'CAST(sum(v) FILTER (y = {y}) AS DOUBLE) AS "y{y}"' for y in _YEARS)
    + ", CAST(sum(v) AS DOUBLE) AS \"Total\" FROM o GROUP BY ROLLUP (p)"
)
def pivotby_sum(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y"), _money("o_totalprice").alias("v"))
    out = aggregate.pivot_by(orders, ["o_orderpriority"], "y", "v", values=_YEARS)
    return out.select("o_orderpriority", *(F.col(str(y)).cast("double").alias(f"y{y}") for y in _YEARS), F.col("Total").cast("double").alias("Total"))


@query(
    "WITH c AS (SELECT o_orderpriority, year(o_orderdate) y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) v FROM orders GROUP BY ALL) "
    "SELECT o_orderpriority, CAST(y AS INTEGER) y, round(v / sum(v) OVER (PARTITION BY y), 6) AS share FROM c"
)
def pivotby_relative(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("v"))
    return aggregate.shares(orders, "o_orderpriority", "y", "v", 0).withColumn("share", F.round("share", 6))


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity * l_quantity AS DECIMAL(18,2))) AS DOUBLE) v FROM lineitem GROUP BY 1")
def lambda_agg(spark, sf_dir):
    """LAMBDA(x, SUM(x*x)) as a compiled expression."""
    square = lambda x: F.sum((x * x).cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(square(F.col("l_quantity")).alias("v"))


for _name, _function, _sql in (
    ("sumifs", lambda: F.sum(_money("l_extendedprice")).cast("double"), "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)"),
    ("countifs", lambda: F.count("*"), "count(*)"),
    ("averageifs", lambda: F.round(F.avg("l_quantity"), 6), "round(avg(l_quantity), 6)"),
    ("maxifs", lambda: F.max("l_extendedprice"), "max(l_extendedprice)"),
    ("minifs", lambda: F.min("l_extendedprice"), "min(l_extendedprice)"),
):

    def _run(spark, sf_dir, f=_function):
        parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
        return lookup.aggregate_if(parts, table(spark, sf_dir, "lineitem"), ["l_partkey"], F.col("l_quantity") > 20, v=f())

    query(f"WITH f AS (SELECT l_partkey, {_sql} v FROM lineitem WHERE l_quantity > 20 GROUP BY 1) SELECT p_partkey AS l_partkey, v FROM part LEFT JOIN f ON p_partkey = l_partkey", _name)(_run)


@query(
    "WITH f AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) shipped FROM lineitem GROUP BY 1) "
    "SELECT o_orderkey, shipped, CASE WHEN l_orderkey IS NULL THEN '#N/A' END err, shipped - o_custkey AS difference FROM orders LEFT JOIN f ON o_orderkey = l_orderkey"
)
def recon(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(_money("l_quantity")).cast("double").alias("shipped"))
    out = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", "shipped", F.when(F.col("l_orderkey").isNull(), "#N/A").alias("err"), (F.col("shipped") - F.col("o_custkey")).alias("difference"))


@query("SELECT o_orderkey, c_mktsegment AS found, CASE WHEN c_custkey IS NULL THEN '#N/A' END err FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def vlookup_exact(spark, sf_dir):
    probes = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return lookup.exact(probes, table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", "c_custkey").select("o_orderkey", "found", "err")


@query("SELECT o_orderkey, c_mktsegment AS found, CASE WHEN c_custkey IS NULL THEN '#N/A' END err FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 3")
def vlookup_miss(spark, sf_dir):
    probes = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 3).alias("c_custkey"))
    return lookup.exact(probes, table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", "c_custkey").select("o_orderkey", "found", "err")


@query(
    "WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error') "
    "SELECT e.event_id, p.value AS found FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts"
)
def lookup_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    probes = events.filter("event_type = 'error'").select("user_id", "ts", "event_id")
    return lookup.as_of(probes, events.filter("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "found")


@query("SELECT p_brand, min(p_partkey) AS first_position FROM part GROUP BY 1")
def xmatch_first(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first_position"))


_CRITERIA = [{"p_size": (">", 30), "p_brand": ("=", "Brand#2")}, {"p_retailprice": ("<", 950)}]
_CRITERIA_SQL = "(p_size > 30 AND p_brand = 'Brand#2') OR p_retailprice < 950"


@query(f"SELECT CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM part WHERE {_CRITERIA_SQL}")
def dsum(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(lookup.matches_any(_CRITERIA)).agg(F.sum(_money("p_retailprice")).cast("double").alias("value"))


@query(f"SELECT count(*) AS value FROM part WHERE {_CRITERIA_SQL}")
def dcount(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(lookup.matches_any(_CRITERIA)).agg(F.count("*").alias("value"))


@query("SELECT p_name AS value, CAST(NULL AS VARCHAR) AS err FROM part WHERE p_partkey = 17")
def dget(spark, sf_dir):
    return lookup.d_get(table(spark, sf_dir, "part"), lookup.matches_any([{"p_partkey": ("=", 17)}]), "p_name")


def _ranked(spark, sf_dir, f):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", f(w).alias("v"))


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) v FROM customer")
def rank_eq(spark, sf_dir):
    return _ranked(spark, sf_dir, lambda w: F.rank().over(w).cast("long"))


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 v FROM customer".replace("2.0", "CAST(2 AS DOUBLE)"))
def rank_avg(spark, sf_dir):
    ties = F.count("*").over(Window.partitionBy("c_mktsegment", "c_acctbal"))
    return _ranked(spark, sf_dir, lambda w: F.rank().over(w) + (ties - 1) / 2)


@query("SELECT c_custkey, floor(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) * 1000) / 1000 v FROM customer")
def percentrank(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", (F.floor(F.percent_rank().over(w) * 1000) / 1000).alias("v"))


@query("SELECT c_mktsegment, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) = 3")
def large(spark, sf_dir):
    return aggregate.kth(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", 3)


@query("SELECT c_mktsegment, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) = 3")
def small(spark, sf_dir):
    return aggregate.kth(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", 3, largest=False)


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, CAST(0.25 AS DOUBLE)), 6) q1, round(quantile_cont(c_acctbal, CAST(0.5 AS DOUBLE)), 6) q2, round(quantile_cont(c_acctbal, CAST(0.75 AS DOUBLE)), 6) q3 FROM customer GROUP BY 1")
def quartile(spark, sf_dir):
    q = [F.round(aggregate.aggregate(17, "c_acctbal", k), 6).alias(f"q{k}") for k in (1, 2, 3)]
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(*q)


_MONTHLY = "SELECT date_trunc('month', o_orderdate) AS month, sum(CAST(o_totalprice AS DECIMAL(18,2))) v FROM orders GROUP BY 1"


@query(f"SELECT CAST(month AS DATE) AS month, CAST(sum(v) OVER (ORDER BY month) AS DOUBLE) AS total FROM ({_MONTHLY})")
def cumulative_cash(spark, sf_dir):
    """A running total over monthly sums; the window sees months and not orders."""
    monthly = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum(_money("o_totalprice")).alias("v"))
    return monthly.select("month", F.sum("v").over(Window.orderBy("month")).cast("double").alias("total"))


@query("SELECT CAST(d AS DATE) AS day, CAST(sum(v) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS DOUBLE) AS total FROM (SELECT date_trunc('day', o_orderdate) d, sum(CAST(o_totalprice AS DECIMAL(18,2))) v FROM orders GROUP BY 1)")
def rolling_sum4(spark, sf_dir):
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(_money("o_totalprice")).alias("v"))
    return daily.select("day", F.sum("v").over(Window.orderBy("day").rowsBetween(0, 3)).cast("double").alias("total"))


def _placed(rows, order):
    """`rows` with their place in `order`: ranked within ranges of the first letter, each range after the sizes of those before."""
    first = F.substring(order[0], 1, 2)
    rows = rows.withColumn("range", first)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    return ranked.join(starts, "range").select("p_partkey", "p_name", (F.col("start") + F.col("at")).alias("place"))


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY upper(p_name), p_partkey) AS place FROM part")
def sort_excel(spark, sf_dir):
    """SORT without regard to case, each row with its place."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return _placed(rows, [F.upper("p_name"), F.col("p_partkey")])


@query("SELECT min(p_type) AS p_type FROM part GROUP BY upper(p_type)")
def unique_ci(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.upper("p_type").alias("k")).agg(F.min("p_type").alias("p_type")).select("p_type")


@query("SELECT p_partkey, p_name FROM part WHERE p_size >= 40 AND p_brand <> 'Brand#1'")
def filter_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size >= 40 and p_brand <> 'Brand#1'").select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 20 OFFSET 5")
def take_drop(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey").orderBy("p_partkey").limit(25).offset(5)


@query("SELECT max(event_id) AS last_row, min(event_id) AS first_row FROM events WHERE event_type = 'error'")
def trimrange(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'error'").agg(F.max("event_id").alias("last_row"), F.min("event_id").alias("first_row"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def vstack(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@query("SELECT " + ", ".join(f"max(n_name) FILTER (n_nationkey = {i}) AS c{i}" for i in range(25)) + " FROM nation")
def transpose_small(spark, sf_dir):
    return table(spark, sf_dir, "nation").agg(*(F.max(F.when(F.col("n_nationkey") == i, F.col("n_name"))).alias(f"c{i}") for i in range(25)))


@query(
    "WITH a AS (SELECT n_regionkey i, n_nationkey j, CAST(n_nationkey + 1 AS DOUBLE) x FROM nation), b AS (SELECT c_nationkey i, c_mktsegment j, CAST(count(*) AS DOUBLE) x FROM customer GROUP BY ALL) "
    "SELECT a.i, b.j, sum(a.x * b.x) x FROM a JOIN b ON a.j = b.i GROUP BY ALL"
)
def mmult(spark, sf_dir):
    a = table(spark, sf_dir, "nation").selectExpr("n_regionkey AS i", "n_nationkey AS j", "cast(n_nationkey + 1 as double) AS x")
    b = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("i"), F.col("c_mktsegment").alias("j")).agg(F.count("*").cast("double").alias("x"))
    return lookup.matrix_product(a, b)


#: Units per base unit, and euro per legacy currency: fixed values.
UNITS = {"lbm": 453.59237, "kg": 1000.0, "ozm": 28.349523125}
EURO = {"DEM": 1.95583, "FRF": 6.55957, "ITL": 1936.27}


@query(
    "SELECT p_partkey, round(p_size * CASE p_partkey % 3 WHEN 0 THEN 453.59237 WHEN 1 THEN 1000.0 ELSE 28.349523125 END / 1000, 6) AS kg FROM part".replace("453.59237", "CAST(453.59237 AS DOUBLE)").replace("28.349523125", "CAST(28.349523125 AS DOUBLE)").replace("1000.0", "CAST(1000 AS DOUBLE)")
)
def convert_units(spark, sf_dir):
    units = spark.createDataFrame(list(UNITS.items()), "unit string, grams double")
    named = table(spark, sf_dir, "part").withColumn("unit", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'lbm' WHEN 1 THEN 'kg' ELSE 'ozm' END"))
    return named.join(F.broadcast(units), "unit").select("p_partkey", F.round(F.col("p_size") * F.col("grams") / 1000, 6).alias("kg"))


@query(
    "SELECT p_partkey, round(p_retailprice / CASE p_partkey % 3 WHEN 0 THEN CAST(1.95583 AS DOUBLE) WHEN 1 THEN CAST(6.55957 AS DOUBLE) ELSE CAST(1936.27 AS DOUBLE) END, 6) AS euro FROM part"
)
def euroconvert(spark, sf_dir):
    rates = spark.createDataFrame(list(EURO.items()), "currency string, rate double")
    named = table(spark, sf_dir, "part").withColumn("currency", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'DEM' WHEN 1 THEN 'FRF' ELSE 'ITL' END"))
    return named.join(F.broadcast(rates), "currency").select("p_partkey", F.round(F.col("p_retailprice") / F.col("rate"), 6).alias("euro"))


@query(
    "SELECT p_partkey, length(p_name) len, upper(p_name) up, left(p_name, 3) l3, right(p_name, 3) r3, substring(p_name, 2, 4) m, replace(p_name, 'ring', 'RING') sub, instr(p_name, ' ') sp, repeat('*', CAST(p_size % 4 AS INTEGER)) rep, "
    "concat(p_brand, '-', p_type) j, split_part(p_brand, '#', 1) AS tb, split_part(p_brand, '#', 2) AS ta, concat(upper(left(split_part(p_name, ' ', 1), 1)), substring(split_part(p_name, ' ', 1), 2)) AS pw FROM part"
)
def text_funcs(spark, sf_dir):
    n, b = F.col("p_name"), F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", X["LEN"](n).alias("len"), X["UPPER"](n).alias("up"), X["LEFT"](n, 3).alias("l3"), X["RIGHT"](n, 3).alias("r3"), X["MID"](n, 2, 4).alias("m"), X["SUBSTITUTE"](n, "ring", "RING").alias("sub"),
        F.coalesce(X["FIND"](" ", n), F.lit(0)).alias("sp"), X["REPT"]("*", F.col("p_size") % 4).alias("rep"), X["CONCAT"](b, "-", F.col("p_type")).alias("j"), X["TEXTBEFORE"](b, "#").alias("tb"), X["TEXTAFTER"](b, "#").alias("ta"),
        X["PROPER"](F.split_part(n, F.lit(" "), F.lit(1))).alias("pw"),
    )


@query("SELECT p_partkey, regexp_matches(p_name, '^s') AS t, nullif(regexp_extract(p_brand, '[0-9]+'), '') AS e, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r FROM part")
def regex_funcs(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", X["REGEXTEST"](n, "^s").alias("t"), X["REGEXEXTRACT"](F.col("p_brand"), "[0-9]+").alias("e"), X["REGEXREPLACE"](n, "[aeiou]", "_").alias("r"))


@query(
    "SELECT o_orderkey, year(d) y, month(d) m, day(d) dd, CAST(isodow(d) % 7 + 1 AS INTEGER) AS wd, CAST(weekofyear(d) AS INTEGER) wn, CAST(d + INTERVAL 1 MONTH AS DATE) ed, last_day(d) em, CAST(d - DATE '1995-01-01' AS INTEGER) AS days FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) d FROM orders)".replace(
        "year(d)", "CAST(year(d) AS INTEGER)").replace("month(d)", "CAST(month(d) AS INTEGER)").replace(" day(d)", " CAST(day(d) AS INTEGER)").replace("weekofCAST(year(d) AS INTEGER)", "weekofyear(d)")
)
def date_funcs(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", X["YEAR"](d).alias("y"), X["MONTH"](d).alias("m"), X["DAY"](d).alias("dd"), X["WEEKDAY"](d).alias("wd"), X["ISOWEEKNUM"](d).alias("wn"), X["EDATE"](d, 1).alias("ed"), X["EOMONTH"](d, 0).alias("em"),
        X["DAYS"](d, F.lit("1995-01-01").cast("date")).alias("days"),
    )


@query(
    "SELECT p_partkey, floor(p_retailprice / 7) q, round(sqrt(p_retailprice), 6) s, round(ln(p_retailprice), 6) l, CAST(p_partkey - 7 * floor(p_partkey / CAST(7 AS DOUBLE)) AS DOUBLE) md, ceil(p_retailprice / 50) * 50 c, floor(p_retailprice / 50) * 50 f, "
    "round(sin(p_size), 9) sn, round(degrees(p_size), 6) dg, CAST(2 * ceil(p_size / 2.0) AS DOUBLE) ev, round(power(p_size, 1.5), 6) pw FROM part"
)
def math_funcs(spark, sf_dir):
    p, s, k = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    d = lambda c: c.cast("double")
    return table(spark, sf_dir, "part").select(
        "p_partkey", d(X["QUOTIENT"](p, 7)).alias("q"), F.round(X["SQRT"](p), 6).alias("s"), F.round(X["LN"](p), 6).alias("l"), d(X["MOD"](k, 7)).alias("md"), d(X["CEILING"](p, 50)).alias("c"), d(X["FLOOR"](p, 50)).alias("f"),
        F.round(X["SIN"](s), 9).alias("sn"), F.round(X["DEGREES"](s), 6).alias("dg"), d(X["EVEN"](s)).alias("ev"), F.round(X["POWER"](s, 1.5), 6).alias("pw"),
    )


@query("SELECT event_id, value IS NULL AS bl, event_id % 2 = 0 AS ev, event_id % 2 = 1 AS od, try_cast(event_type AS DOUBLE) IS NOT NULL AS nm FROM events")
def info_funcs(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", X["ISBLANK"](F.col("value")).alias("bl"), X["ISEVEN"](e).alias("ev"), X["ISODD"](e).alias("od"), X["ISNUMBER"](F.col("event_type")).alias("nm"))


@query(
    "SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS i, CASE WHEN value > 80 THEN 'a' WHEN value > 40 THEN 'b' WHEN true THEN 'c' END AS s, value > 10 AND value < 90 AS a, value < 10 OR value > 90 AS o, "
    "(value > 50) <> (event_id % 2 = 0) AS x, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS w FROM events"
)
def logic_funcs(spark, sf_dir):
    v, e = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", X["IF"](v > 50, "high", "low").alias("i"), X["IFS"](v > 80, "a", v > 40, "b", True, "c").alias("s"), X["AND"](v > 10, v < 90).alias("a"), X["OR"](v < 10, v > 90).alias("o"),
        X["XOR"](v > 50, e % 2 == 0).alias("x"), X["SWITCH"](F.col("event_type"), "error", 1, "purchase", 2, 0).alias("w"),
    )


@query("SELECT event_id, event_id & 12 a, event_id | 5 o, xor(event_id, 9) x, event_id * 4 l, event_id // 4 r FROM events")
def bit_funcs(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", *(X[f](e, n).cast("long").alias(c) for f, n, c in (("BITAND", 12, "a"), ("BITOR", 5, "o"), ("BITXOR", 9, "x"), ("BITLSHIFT", 2, "l"), ("BITRSHIFT", 2, "r"))))


@query("SELECT event_id, upper(to_hex(event_id)) h, to_binary(event_id) b, event_id AS back FROM events")
def base_funcs(spark, sf_dir):
    e = F.col("event_id")
    h = X["DEC2HEX"](e)
    return table(spark, sf_dir, "events").select("event_id", h.alias("h"), X["DEC2BIN"](e).alias("b"), X["HEX2DEC"](h).cast("long").alias("back"))


@query("SELECT o_orderkey, round(-(o_totalprice * pow(1 + r, 24)) / ((pow(1 + r, 24) - 1) / r), 6) v FROM (SELECT o_orderkey, o_totalprice, CAST(0.01 AS DOUBLE) r FROM orders)")
def finance_pmt(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(X["PMT"](0.01, 24, F.col("o_totalprice")), 6).alias("v"))


@query("SELECT o_orderkey, round(o_totalprice / 1.1 + o_totalprice / 2 / 1.21 + 100 / 1.331, 4) v FROM orders".replace("1.1 ", "CAST(1.1 AS DOUBLE) ").replace("1.21", "pow(CAST(1.1 AS DOUBLE), 2)").replace("1.331", "pow(CAST(1.1 AS DOUBLE), 3)"))
def finance_npv(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(X["NPV"](0.1, p, p / 2, 100), 4).alias("v"))


@query("SELECT o_orderkey, round((o_totalprice - 1000) / 10, 6) sln, round((o_totalprice - 1000) * 8 * 2 / 110, 6) syd FROM orders")
def finance_sln(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(X["SLN"](p, 1000, 10), 6).alias("sln"), F.round(X["SYD"](p, 1000, 10, 3), 6).alias("syd"))


@query("SELECT o_orderkey, round(o_totalprice * r * pow(1 - r, 2), 4) v FROM (SELECT o_orderkey, o_totalprice, round(1 - pow(1000 / o_totalprice, CAST(0.1 AS DOUBLE)), 3) r FROM orders)")
def finance_db(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(X["DB"](p, 1000, F.lit(10), 3), 4).alias("v"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 3) intercept, round(regr_r2(l_extendedprice, l_quantity), 6) r2 FROM lineitem GROUP BY 1")
def stats_regression(spark, sf_dir):
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("SELECT l_returnflag, round(var_pop(l_quantity), 6) var, round(kurtosis_pop(l_quantity), 5) kurt, round(exp(avg(ln(l_quantity))), 6) geo, round(1 / avg(1 / l_quantity), 6) har FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def stats_moments(spark, sf_dir):
    q = "l_quantity"
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 0").groupBy("l_returnflag").agg(
        F.round(F.var_pop(q), 6).alias("var"), F.round(F.kurtosis(q), 5).alias("kurt"), F.round(F.exp(F.avg(F.log(q))), 6).alias("geo"), F.round(1 / F.avg(1 / F.col(q)), 6).alias("har")
    )


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) c, round(covar_pop(l_quantity, l_extendedprice), 3) cp, round(covar_samp(l_quantity, l_extendedprice), 3) cs FROM lineitem GROUP BY 1")
def stats_corr(spark, sf_dir):
    a, b = "l_quantity", "l_extendedprice"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr(a, b), 6).alias("c"), F.round(F.covar_pop(a, b), 3).alias("cp"), F.round(F.covar_samp(a, b), 3).alias("cs"))


_DAYS = "(SELECT o_orderkey, CAST(o_orderdate AS DATE) a, CAST(o_orderdate AS DATE) + CAST(o_custkey % 40 AS INTEGER) b FROM orders)"
_WORK = "(({0}) // 7 * 5 + least(({0}) % 7, 5))"


@query(f"SELECT o_orderkey, CAST({_WORK.format("b - DATE '1900-01-01' + 1")} - {_WORK.format("a - DATE '1900-01-01'")} AS BIGINT) v FROM {_DAYS}")
def networkdays(spark, sf_dir):
    a = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", X["NETWORKDAYS"](a, F.date_add(a, (F.col("o_custkey") % 40).cast("int"))).cast("long").alias("v"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_custkey % 14 AS INTEGER)) AS DATE) e, last_day(CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_custkey % 14 AS INTEGER)) AS DATE)) m FROM orders")
def edate_eomonth(spark, sf_dir):
    d, n = F.to_date("o_orderdate"), F.col("o_custkey") % 14
    return table(spark, sf_dir, "orders").select("o_orderkey", X["EDATE"](d, n).alias("e"), X["EOMONTH"](d, n).alias("m"))


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages")
def filterxml(spark, sf_dir):
    """The title element of each page, by XPath over a well-formed fragment."""
    fragment = F.regexp_extract("html", "(<title>.*?</title>)", 1)
    bare = F.regexp_replace(F.regexp_replace(fragment, "&", "&amp;"), r"(?<=>)([^<]*)(?=<)", "$1")
    return table(spark, sf_dir, "pages").select("page_id", F.xpath_string(bare, F.lit("/title")).alias("title"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_ops(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return parsed.filter("p.k is not null").select("event_id", F.col("p.k").alias("k"))


@query(
    "SELECT c_custkey, least(h, 40) AS regular, greatest(h - 40, 0) AS overtime, CASE WHEN h > 40 THEN 40 * 20 + (h - 40) * 30 ELSE h * 20 END AS pay FROM (SELECT c_custkey, c_custkey % 60 h FROM customer)"
)
def payroll(spark, sf_dir):
    h = F.col("c_custkey") % 60
    return table(spark, sf_dir, "customer").select("c_custkey", F.least(h, F.lit(40)).alias("regular"), F.greatest(h - 40, F.lit(0)).alias("overtime"), X["IF"](h > 40, 40 * 20 + (h - 40) * 30, h * 20).alias("pay"))


@query("SELECT o_orderkey, o_totalprice > 100000 AS over_limit, CASE WHEN o_totalprice > 100000 THEN o_totalprice - 100000 ELSE 0 END AS excess FROM orders")
def claims_check(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", (p > 100000).alias("over_limit"), X["IF"](p > 100000, p - 100000, 0.0).alias("excess"))


@query(
    "SELECT CAST(n_regionkey AS INTEGER) region, CAST(sum(v) AS DOUBLE) total FROM (SELECT c_nationkey k, CAST(c_acctbal AS DECIMAL(18,2)) v FROM customer UNION ALL SELECT s_nationkey, CAST(s_acctbal AS DECIMAL(18,2)) FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1"
)
def consolidation(spark, sf_dir):
    both = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), _money("c_acctbal").alias("v")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), _money("s_acctbal").alias("v")))
    per = both.groupBy("k").agg(F.sum("v").alias("v"))
    return per.join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region")).agg(F.sum("v").cast("double").alias("total"))


@query("SELECT CASE event_type WHEN 'error' THEN 'WEBSERVICE' WHEN 'purchase' THEN 'RTD' ELSE 'SUM' END AS name, CASE event_type WHEN 'error' THEN '#VALUE!' WHEN 'purchase' THEN '#N/A' END AS literal, count(*) n FROM events GROUP BY ALL")
def policy_literals(spark, sf_dir):
    """What a function that is never executed shows instead."""
    from cellgrid.functions.policy import LITERALS

    literal = F.create_map(*(F.lit(x) for pair in LITERALS.items() for x in pair))
    name = F.expr("CASE event_type WHEN 'error' THEN 'WEBSERVICE' WHEN 'purchase' THEN 'RTD' ELSE 'SUM' END")
    return table(spark, sf_dir, "events").select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n")).select("name", F.try_element_at(literal, F.col("name")).alias("literal"), "n")
