"""Where the test tables are, and how a query reads one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of `sf_dir`, read by Spark's own reader so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
