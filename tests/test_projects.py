"""Projects as graphs, and predicates."""

import json

from pyspark.sql import functions as F

from cellgrid.operators import graph, predicates
from cellgrid.sources import projects


def test_models(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.sql").write_text("SELECT 1 AS x")
    (tmp_path / "m" / "b.sql").write_text("SELECT x + 1 AS y FROM {{ ref('a') }}")
    (tmp_path / "m" / "c.sql").write_text("{% if x %} SELECT 1 {% endif %}")
    found = projects.sql_models(spark, str(tmp_path))
    rows = {r.model: r for r in found.collect()}
    assert rows["b"].refs == ["a"] and rows["b"].plain and not rows["c"].plain
    nodes, edges = projects.model_graph(found.filter("plain"))
    assert [tuple(r) for r in edges.collect()] == [("b", 0, "a")]
    same = nodes.select("node", F.col("node").alias("new"))
    assert graph.certify(nodes, edges, nodes, edges, same).count() == 0
    assert graph.run_models(spark, {r.model: r.sql for r in rows.values() if r.plain}, "b").first().y == 2


def test_notebooks(spark, tmp_path):
    cell = lambda kind, *lines: {"cell_type": kind, "source": list(lines)}
    cells = [cell("markdown", "# t"), cell("code", "import os\n", "x = 1"), cell("code", "%time\n"), cell("code", ""), cell("code", "y = x")]
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": cells}))
    assert [r.kind for r in projects.notebook_cells(spark, str(tmp_path)).orderBy("at").collect()] == ["markdown", "definition", "magic", "empty", "code"]


def test_tables_with_generated_columns(spark):
    t = spark.createDataFrame([(1, 2, 3, 5)], "k int, a int, b int, c int")
    nodes, edges = projects.table_graph(t, "k", {"c": "a + b"})
    assert {(r.node, r.op) for r in nodes.collect()} == {("a@1", "stored"), ("b@1", "stored"), ("c@1", "a + b")}
    assert sorted((r.pos, r.dep) for r in edges.collect()) == [(0, "a@1"), (1, "b@1")]


def test_predicates(spark):
    f = spark.createDataFrame([('=INDIRECT("A1")', True, False), ('="OFFSET("&A1', False, False), ("=SUM(A:A)", False, True), ("=T[x]", False, True), ("=S!A1", False, True), ("=SUM(A1:B2)", False, False)], "f string, dynamic boolean, outside boolean")
    assert f.filter((predicates.dynamic_reference(F.col("f")) != F.col("dynamic")) | (predicates.uncertifiable(F.col("f")) != F.col("outside"))).count() == 0
    n = spark.createDataFrame([("AB12", True), ("R1C1", True), ("Rate", False), ("XFE1", False)], "n string, want boolean")
    assert n.filter(predicates.looks_like_cell(F.col("n")) != F.col("want")).count() == 0
