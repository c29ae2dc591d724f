"""Projects of SQL models, notebooks, and tables with generated columns, as nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.operators.predicates import leftover_template

_REF = r"\{\{\s*ref\(\s*'(\w+)'\s*\)\s*\}\}"


def sql_models(spark: SparkSession, path: str) -> DataFrame:
    """(model, sql, refs, plain): the .sql files under a path, the models that each names, and whether no other template is left."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").text(path, wholetext=True)
    named = text.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.sql$", 1).alias("model"), F.col("value").alias("sql"))
    refs = F.array_distinct(F.regexp_extract_all("sql", F.lit(_REF), 1))
    return named.select("model", "sql", refs.alias("refs"), (~leftover_template(F.regexp_replace("sql", _REF, "x"))).alias("plain"))


def model_graph(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node, op) and edges (node, pos, dep); an op is the model's text with its references by place."""
    op = F.regexp_replace(F.lower(F.regexp_replace("sql", _REF, "#")), r"\s+", " ")
    return models.select(F.col("model").alias("node"), op.alias("op")), models.select(F.col("model").alias("node"), F.posexplode("refs").alias("pos", "dep"))


def notebook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(notebook, at, kind, source): cells are markdown, empty, magic, definition or code."""
    schema = "cells array<struct<cell_type: string, source: array<string>>>"
    books = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.ipynb").option("recursiveFileLookup", "true").json(path)
    cells = books.select(F.col("_metadata.file_name").alias("notebook"), F.posexplode("cells").alias("at", "c"))
    source = F.array_join("c.source", "")
    kind: Column = (
        F.when(F.col("c.cell_type") != "code", F.col("c.cell_type")).when(F.trim(source) == "", "empty").when(source.rlike(r"(?m)^\s*[%!]"), "magic")
        .when(source.rlike(r"(?m)^(def|class|import|from)\b"), "definition").otherwise("code")
    )
    return cells.select("notebook", "at", kind.alias("kind"), source.alias("source"))


def table_graph(table: DataFrame, key: str, generated: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """A table's cells as nodes `column@key` with the op of their column (stored, or its expression), and edges to the columns that an expression names."""
    names = [c for c in table.columns if c != key]
    node = lambda c: F.concat(F.lit(f"{c}@"), F.col(key).cast("string"))
    nodes = table.select(F.explode(F.array(*(F.struct(node(c).alias("node"), F.lit(generated.get(c, "stored")).alias("op"), F.col(c).cast("string").alias("value")) for c in names))).alias("n")).select("n.*")
    import re

    pairs = [(c, pos, d) for c, e in generated.items() for pos, d in enumerate(dict.fromkeys(w for w in re.findall(r"[A-Za-z_]\w*", e) if w in names))]
    if not pairs:
        return nodes, nodes.select("node", F.lit(0).alias("pos"), F.col("node").alias("dep")).limit(0)
    edges = table.select(F.explode(F.array(*(F.struct(node(c).alias("node"), F.lit(pos).alias("pos"), node(d).alias("dep")) for c, pos, d in pairs))).alias("e")).select("e.*")
    return nodes, edges
