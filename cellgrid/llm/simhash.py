"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits share at least five of their eight bytes
in place. The index holds, for each of 14 choices of four byte positions, the bytes there; the
choices are the blocks of the Steiner system S(3, 4, 8): any three positions lie in one block, whose
complement is a block too, so wherever three bits differ, one block's four bytes are shared. (Postings
of single bytes would hold a 256th of all fingerprints each, so their pairs grow with the square of
the input.) For the pairs that meet, shared positional bytes are tallied; pairs with the guaranteed
five are verified on all 64 bits. Only distinct fingerprints enter, a posting fixes 32 bits, and
inside one, links are kept as a spanning forest, so a group of near copies never becomes its pairs.

Null and empty texts and texts of white space have the fingerprint zero. Rows with equal doc_id
count as one document of that id for its component. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.components import components
from cellgrid.llm.cluster import bounded, written

SHINGLE = 3
DISTANCE = 3
SEED = 42
_BLOCK = 1 << 15


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the text's word shingles in order, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows of `hashes` (n, words of 64 bits), as words."""
    words = hashes.shape[1]
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = np.ascontiguousarray(hashes[at : at + _BLOCK]).astype("<u8").view(np.uint8).reshape(-1, 8 * words)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((majority(shingle_hashes(t.as_py(), shingle)[:, None])[0] for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    source = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def _posting_masks(distance: int) -> list[int]:
    """Masks of byte positions such that any pair within `distance` bits shares all bytes of one."""
    if distance == 3:  # the blocks of S(3, 4, 8)
        kept = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
    else:
        kept = list(combinations(range(8), 8 - distance))
    masks = [sum(0xFF << (8 * b) for b in c) for c in kept]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Whether pairs of fingerprints tally enough shared positional bytes and, verified, differ in at most `distance` bits."""
    apart = np.ascontiguousarray(x ^ y)
    near = (apart[..., None].view(np.uint8) == 0).sum(axis=-1, dtype=np.uint8) >= 8 - distance
    near[near] = np.bitwise_count(apart[near]) <= distance
    return near


def forest(fps: np.ndarray, distance: int, free: int) -> np.ndarray:
    """For each of the distinct sorted `fps`, the least index that it is linked with, directly or through others.

    free: mask of the bits in which they can differ. Small postings tally all pairs; large ones look up
    each change of up to `distance` free bits (which leaves the other bytes shared), so the work grows
    with their size and not its square.
    """
    n = len(fps)
    label = np.arange(n)
    if n <= 1024:
        near = linked(fps[:, None], fps[None, :], distance)
        while True:
            new = np.where(near, label[None, :], n).min(axis=1)
            new = np.minimum(new, new[new])
            if (new == label).all():
                return label
            label = new
    bits = [1 << b for b in range(64) if free >> b & 1]
    changes = [sum(c) for k in range(1, distance + 1) for c in combinations(bits, k)]
    while True:
        old = label.copy()
        for change in changes:
            other = fps ^ np.uint64(change)
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            found = fps[at] == other
            label[found] = np.minimum(label[found], label[at[found]])
        label = np.minimum(label, label[label])
        if (label == old).all():
            return label


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`distinct` (fp: long) -> (a, b) links between different fingerprints, enough to connect all within `distance`."""
    masks = _posting_masks(distance)
    postings = distinct.select(F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("place"), "fp").select(
        "place", F.col("fp").bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), F.col("place") + 1)).alias("kept"), "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in _and_last(batches):
            if batch is not None:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            place, kept, fp = held
            if not len(fp):
                continue
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (kept[1:] != kept[:-1])) + 1
            edges = np.concatenate(([0], cuts, [len(fp)] if batch is None else []))
            edges = edges.astype(np.int64)
            sizes = np.diff(edges)
            a, b = [], []
            pairs = edges[:-1][sizes == 2]
            near = linked(fp[pairs].view(np.uint64), fp[pairs + 1].view(np.uint64), distance)
            a.append(fp[pairs[near]])
            b.append(fp[pairs[near] + 1])
            for at, size in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = np.sort(fp[at : at + size].view(np.uint64))
                root = forest(own, distance, ~masks[int(place[at])] & (2**64 - 1))
                tied = root != np.arange(size)
                a.append(own[tied].view(np.int64))
                b.append(own[root[tied]].view(np.int64))
            held = [x[edges[-1] :] for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    sorted_postings = postings.repartition("place", "kept").sortWithinPartitions("place", "kept")
    return sorted_postings.mapInArrow(run, "a long, b long").distinct()


def _and_last(batches: Iterator) -> Iterator:
    """The batches, then None."""
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per row of `docs` its fingerprint (16 hex digits) and the smallest doc_id that it is linked with, directly or not."""
    prints = written(fingerprints(docs, shingle), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = written(links(distinct.select("fp"), distance), "simhash-links")
    ids = found.join(distinct.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a")), "a").join(
        distinct.select(F.col("fp").alias("b"), F.col("rep").alias("rep_b")), "b"
    )
    roots = components(ids.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    classes = distinct.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
