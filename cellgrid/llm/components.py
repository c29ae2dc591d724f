"""Connected components of links, as joins and aggregations that run until nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.cluster import drop_written, written


#: Links that one part contracts.
AT_ONCE = 200_000


def components(links: DataFrame) -> DataFrame:
    """`links` (a, b: long) -> (node, component): the smallest node reachable; nodes without links are left out.

    Links are first contracted to stars within each partition, in parts of bounded size. Then alternates two steps: each node's larger neighbours are linked to its smallest neighbour, then
    its smaller ones are. Stars remain, after a logarithmic number of rounds. A node's smallest
    neighbour is a partial aggregate, so a node with very many links costs no more.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # a node's links side by side where they are few enough, as they are contracted best so; any dealing is right
    links = written(links.hint("rebalance", "a").mapInArrow(_stars, "a long, b long").distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        after = written(small.select("l.*").filter("a <> b").distinct().mapInArrow(_stars, "a long, b long"), "links")
        now = _mark(after)
        drop_written(links)
        links = after
        if now == mark:
            break
        mark = now
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from each node to the smallest one that the links of its part reach; a part has AT_ONCE links or little more."""
    root: dict[int, int] = {}
    n = 0

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def made() -> pa.RecordBatch:
        pairs = [(x, top) for x in root if (top := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        n += batch.num_rows
        if n >= AT_ONCE:
            yield made()
            root.clear()
            n = 0
    yield made()


def _mark(links: DataFrame) -> tuple:
    """The number of links and a checksum that no order changes."""
    spread = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.coalesce(F.bit_xor(spread), F.lit(0)), F.coalesce(F.sum(spread.cast("decimal(38,0)")), F.lit(0))).first())
