"""Journals and patches: JSON lines that may end torn, and edits as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECEIPT = (
    "rev long, kind string, base_hash string, result_hash string, ops string, timestamp string, actor string, engine_version string, clock string, seed long"
)
PATCH = (
    "base_hash string, actor string, ops array<struct<op: string, sheet: string, cell: string, value: string, formula: string>>, watch array<string>, clock string, seed long"
)


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """Receipts of the journals under a path (`<book>.jsonl`), numbered by line.

    A last line that can't be read is torn and left out if the file has no newline at its end; any other bad line fails the read.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)\.jsonl$", 1).alias("book"), F.decode("content", "UTF-8").alias("text"))
    lines = files.select("book", (~F.endswith("text", F.lit("\n"))).alias("open"), F.posexplode(F.split("text", "\n")).alias("at", "line"), F.size(F.split("text", "\n")).alias("n"))
    lines = lines.filter(F.trim("line") != "").select("book", (F.col("at") + 1).cast("long").alias("line_no"), "line", F.from_json("line", RECEIPT).alias("r"), (F.col("open") & (F.col("at") == F.col("n") - 1)).alias("last_open"))
    bad = F.col("r.rev").isNull() & F.col("r.result_hash").isNull()
    checked = lines.filter(~(bad & F.col("last_open"))).withColumn("ok", F.when(bad, F.raise_error(F.concat(F.lit("bad journal line "), F.col("line_no").cast("string")))).otherwise(F.lit(True)))
    return checked.filter("ok").select("book", "line_no", "r.*")


def patch_operations(spark: SparkSession, path: str) -> DataFrame:
    """The operations of patch documents, one a row; a document that doesn't fit fails the read."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", PATCH, {"mode": "FAILFAST"}).alias("p"))
    return parsed.select("p.base_hash", "p.actor", F.posexplode("p.ops").alias("pos", "o")).select("base_hash", "actor", "pos", "o.*")


def shift_batch(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (formula, axis, op, at, count) rows."""
    return spark.read.csv(path, sep="\t", schema="formula string, axis string, op string, at int, count int", quote="")
