"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm import bytebpe, fingerprints, licenses, mainhtml, neighbours, packing, repeats, sharding, simhash, toxicity
from cellgrid.llm.cluster import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(_table(spark, sf_dir, "pages"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.exact_groups(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    rows = sharding.sharded(_table(spark, sf_dir, "documents"), store, by="source")
    return rows.select("doc_id", "source", F.sha2("text", 256).alias("text_sha256"), "shard", "shard_bytes")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_suffix_arrays, op2_licenses, op3_simhash, op4_neighbours, op5_toxicity, op6_main_text, op7_fingerprints, op8_packing, op9_sharding, op10_byte_bpe)}

SQL: dict[str, str] = {}
