"""Approximate nearest neighbours by inner product: NN-descent builds a graph, greedy search reads it.

Equal vectors are one node, with the ids that can be among a query's nearest, so copies cost nothing.
Nodes are dealt to shards of bounded size by a hash of their id, so shards depend on the table alone
and not on how Spark partitions it. Each shard is one task: it builds the graph of its nodes by
NN-descent (`nngraph.py`) and answers every query by greedy search of that graph, in parts that stream
through it; a query's answers from all shards are merged by their exact scores. So graphs have a bounded
size however large the table is, and graph and search send a node's vector once and a query's to every
shard. With more shards a query needs less of each, and from four on a shard's beam is half as wide.
A shard of few nodes is compared exactly.

Vectors that are null, zero, hold null or non-finite components, or have another number of
components than most, take no part. Of rows with one vec_id the least vector counts; a null vec_id
takes no part. Ties go to the smaller vec_id. With fewer candidates than asked for, all are returned.
Empty tables give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm import nngraph
from cellgrid.llm.cluster import drop_written, tables, written

TOP = 20
#: Nodes of a shard at most, and components of its vectors; queries held and answered at once.
SHARD_ROWS, SHARD_VALUES, QUERIES, ASKED = 32_768, 1 << 24, 1024, 64


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v: array of double) of the vectors that take part."""
    v = F.col("v")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(~odd & F.exists(v, lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").first()
    rows = rows.filter(F.size("v") == (usual.n if usual else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def classes(vectors: DataFrame, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(node, v) of the different vectors, and (node, vec_id) with the least top + 1 ids of each."""
    hashed = vectors.select("vec_id", "v", F.xxhash64("v").alias("h"))
    nodes = hashed.groupBy("h", "v").agg(F.min("vec_id").alias("node"))
    order = Window.partitionBy("h", "v").orderBy("vec_id")
    members = hashed.withColumn("k", F.row_number().over(order)).filter(f"k <= {top + 1}")
    return nodes.select("node", "v"), members.join(nodes, ["h", "v"]).select("node", "vec_id")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component to the last."""
    out = np.zeros(len(q))
    with np.errstate(all="ignore"):
        for k in range(q.shape[1]):
            out += q[:, k] * x[:, k]
    return out


def _answers(node: np.ndarray, x: np.ndarray, walk: nngraph.Walk, query_id: np.ndarray, own: np.ndarray, q: np.ndarray, keep: int) -> pa.RecordBatch:
    """(query_id, node, s): the `keep` best nodes that each query reaches in a shard, by their exact scores."""
    at = np.minimum(np.searchsorted(node, own), len(node) - 1)
    near = (q / np.abs(q).max(axis=1, keepdims=True)).astype(walk.x.dtype)
    found = walk.nearest(near, np.where(node[at] == own, at, -1))[:, : 2 * keep]
    i, j = np.nonzero(found >= 0)
    w = found[i, j]
    s = scores(q[i], x[w])
    order = np.lexsort((w, -s, i))  # rows of a shard stand in the order of their nodes
    i, w, s = i[order], w[order], s[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < keep
    return pa.RecordBatch.from_arrays([pa.array(query_id[i[best]]), pa.array(node[w[best]]), pa.array(s[best])], names=["query_id", "node", "s"])


def search(nodes: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """`queries` (query_id, node, v) -> (query_id, node, s): in every shard of `nodes` the best that greedy search reaches, the query's own among them."""
    size = nodes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dims")).first()
    shards = max(1, math.ceil(size.n / min(SHARD_ROWS, max(1, SHARD_VALUES // size.dims))))
    parts = max(1, math.ceil(queries.count() / QUERIES))
    beam = min(nngraph.BEAM, max(nngraph.BEAM // 2, 2 * nngraph.BEAM // shards))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables(batches, 2):
            part, ids, own = (table.column(k).to_numpy() for k in (1, 2, 3))
            v = _matrix(table.column(4).combine_chunks())
            if part[0] == 0:
                node, x = ids, v
                walk = nngraph.Walk(nngraph.Graph(nngraph.scaled(x)).descend(), beam)
                continue
            for a in range(0, len(ids), ASKED):
                b = slice(a, a + ASKED)
                yield _answers(node, x, walk, ids[b], own[b], v[b], top + 1)

    shard = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard")
    held = nodes.select(shard, F.lit(0).alias("part"), F.col("node").alias("id"), "node", "v")
    part = (F.pmod(F.xxhash64("query_id"), F.lit(parts)) + 1).cast("int").alias("part")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), part, F.col("query_id").alias("id"), "node", "v")
    dealt = held.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "part", "id")
    return dealt.mapInArrow(answered, "query_id long, node long, s double")


def nearest(table: DataFrame, every: int = 20, top: int = TOP) -> DataFrame:
    """For each row whose vec_id is divisible by `every`, its `top` nearest other rows: query_id, rank, vec_id, score."""
    vectors = written(valid_vectors(table), "vectors")
    nodes, members = classes(vectors, top)
    nodes, members = written(nodes, "nodes"), written(members, "members")
    asked = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    asked = asked.withColumn("h", F.xxhash64("v")).join(nodes.select("node", F.xxhash64("v").alias("h"), F.col("v").alias("nv")), "h").filter("v = nv").select("query_id", "node", "v")
    near = Window.partitionBy("query_id").orderBy(F.desc("s"), "node")
    found = search(nodes, asked, top).withColumn("k", F.row_number().over(near)).filter(f"k <= {top + 1}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = found.join(members, "node").filter("vec_id <> query_id").select("query_id", "vec_id", F.col("s").alias("score"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {top}")
    result = written(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
    for frame in (vectors, nodes, members):
        drop_written(frame)
    return result
