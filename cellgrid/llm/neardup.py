"""Near-duplicate documents by a wide SimHash, its byte-position index, and exact verification.

For the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Such pairs differ in about 15 of 100 SimHash bits, so no number of equal bytes of a 64-bit
fingerprint is guaranteed, and a fingerprint of 768 bits is used. At similarity 0.8 a pair shares
about 26 of its 96 bytes in place, a pair of unrelated documents 0.4. The index holds KEYS triples of
byte positions with the bytes there (three shared bytes are the minimum that a pair must reach to
meet); pairs that meet are counted as related if their first 128 bits are close. With 160 triples a
pair at 0.8 is expected to meet in three of them, a pair at 0.9 in ten.

Exact copies (equal shingle sets) enter once. A posting gives a spanning forest of its related rows,
one link a row, never its pairs; related documents, directly or through others, are a family. Inside
a family verification is exact and its work stays near its size:

1. every document is verified against its smallest relative, which joins a group of n by n pairs;
2. families that are not one group then are searched by prefix filter: two sets of similarity 0.8
   share one of each one's rarest fifth of shingles, rarity counted within the family, so a document
   with over a fifth of its own is compared with nothing;
3. rows that share such a shingle with a row of another group are verified all against all, by
   counting common shingles in blocks of bounded size; rows of a family's largest group are not
   compared with each other. What a block gives are the links that join groups, never its pairs.

So the groups are the connected components of all pairs at 0.8 or more inside families; only a pair
that shares no triple, directly or through relatives, can be missed.

Null and empty texts have no shingles: they are copies of each other. Rows with equal or null doc_id
are documents of their own where their texts differ. Texts of any length are read whole. Other
columns are kept as they are, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm.cluster import bounded, drop_written, tables, written
from cellgrid.llm.components import components
from cellgrid.llm.simhash import shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
WORDS = 12  # of 64 bits
#: Triples of byte positions, and how many of them are shuffled at once.
KEYS, KEYS_AT_ONCE = 160, 80
#: Postings carry the first SEEN words of a signature to tell who is close.
SEEN = 2
#: Of their 128 bits; pairs at similarity 0.8 differ in 19 on average, with a deviation of 4, unrelated ones in 64.
DIFFERING = 36
#: Documents of a posting that are compared with each other at once.
BLOCK = 2048
#: Rows of a family that are verified against each other in one task, and their shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
#: Parts that a family's rows are dealt to.
SALTS = 32


def signature(hashes: np.ndarray) -> np.ndarray:
    """A SimHash of WORDS words of 64 bits over hashed shingles."""
    wide = hashes[:, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wide = (wide ^ (wide >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    wide = (wide ^ (wide >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    wide ^= wide >> np.uint64(31)
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(wide), 255):  # so many that a byte holds their sum
        block = np.unpackbits(np.ascontiguousarray(wide[at : at + 255]).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(block, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(wide), bitorder="little").view("<u8")


def triples() -> np.ndarray:
    """KEYS triples of the byte positions: laps of a shuffle, cut into threes."""
    rng, n = np.random.default_rng(5), 8 * WORDS
    laps = [rng.permutation(n)[: n - n % 3].reshape(-1, 3) for _ in range(-(-KEYS // (n // 3)))]
    return np.concatenate(laps)[:KEYS]


def signatures(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, long columns `more`, s0, s1.., copy): the signature's words and a 128-bit digest, both of the set of shingles."""
    names = [f"s{w}" for w in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.unique(shingle_hashes(text.as_py(), SHINGLE)) for text in batch.column(batch.num_columns - 1)]
            sigs = np.array([signature(h) for h in hashes], np.uint64).reshape(-1, WORDS).view(np.int64)
            copies = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in hashes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(sigs[:, w].copy()) for w in range(WORDS)), copies], names=["doc_id", *more, *names, "copy"])

    return bounded(docs).select("doc_id", *more, "text").mapInArrow(run, f"doc_id long, {', '.join(n + ' long' for n in (*more, *names))}, copy binary")


def links(distinct: DataFrame, first: int = 0, last: int = KEYS) -> DataFrame:
    """`distinct` (rep, s0, s1..) -> (a, b), b < a: rows that share one of the triples of bytes first..last and differ in few
    bits, as a spanning forest of each posting."""
    byte = lambda at: F.shiftrightunsigned(f"s{at // 8}", 8 * (at % 8)).bitwiseAND(255)
    keys = [(F.lit((k - KEYS // 2) << 24) + byte(x) * 65536 + byte(y) * 256 + byte(z)).cast("int") for k, (x, y, z) in enumerate(triples().tolist()) if first <= k < last]
    shared = distinct.select(F.explode(F.array(*keys)).alias("key"), "rep", *(f"s{w}" for w in range(SEEN)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rep, *words in _whole_groups(batches):
            sig = np.stack([w.view(np.uint64) for w in words], axis=1)
            ends = _ends(key)
            at, sizes = ends[:-1], np.diff(ends)
            two = at[sizes == 2]
            two = two[np.bitwise_count(sig[two] ^ sig[two + 1]).sum(axis=1) <= DIFFERING]
            rows, roots = [two + 1], [two]
            for i, size in zip(at[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                root = forest(sig[i : i + size])
                linked = np.flatnonzero(root != np.arange(size))
                rows.append(linked + i)
                roots.append(root[linked] + i)
            rows, roots = np.concatenate(rows), np.concatenate(roots)
            yield pa.RecordBatch.from_arrays([pa.array(rep[rows]), pa.array(rep[roots])], names=["a", "b"])

    return shared.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, "a long, b long").distinct()


def forest(sig: np.ndarray) -> np.ndarray:
    """For each row of a posting the least row that it is close to, directly or through others.

    The first row takes all that are close to it; in large postings each row outside the largest group
    is then compared with all, so a posting of near copies costs its size and not its square.
    """
    n = len(sig)
    close = _apart(sig[:1], sig)[0] <= DIFFERING
    if close.all():
        return np.zeros(n, np.int64)
    if n <= BLOCK:
        near, label = _apart(sig, sig) <= DIFFERING, np.arange(n)
        while True:
            new = np.where(near, label[None, :], n).min(axis=1)
            new = np.minimum(new, new[new])
            if (new == label).all():
                return label
            label = new
    label, done = np.arange(n), np.zeros(n, bool)
    while True:
        left = np.flatnonzero(~done & (label != np.argmax(np.bincount(label))))
        if not len(left):
            return label
        met = np.unique(label[_apart(sig[left[:1]], sig)[0] <= DIFFERING])
        label[np.isin(label, met)] = met[0]
        done[left[0]] = True


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of bits in which each row of x differs from each row of y."""
    apart = np.zeros((len(x), len(y)), np.int16)
    for w in range(x.shape[1]):
        apart += np.bitwise_count(x[:, w][:, None] ^ y[:, w][None, :])
    return apart


def _ends(key: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin, and the end."""
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut so that rows that are equal in the first column stay together."""
    held: list = []  # parts that have no end of a group yet
    for batch in _and_last(batches):
        new = [] if batch is None else [c.to_numpy() for c in batch.columns]
        if batch is not None and not batch.num_rows:
            continue
        if new and held and new[0][-1] == held[0][0][0]:
            held.append(new)
            continue
        columns = [np.concatenate(c) for c in zip(*held, new, strict=True)] if held and new else new
        if batch is None:
            if held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
            return
        cut = _ends(columns[0])[-2]
        if cut:
            yield [c[:cut] for c in columns]
        held = [[c[cut:] for c in columns]]


def _and_last(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """`docs` (node, text) -> (node, shingles): the set of hashed shingles of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), SHINGLE)).view(np.int64) for t in batch.column(1)]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose sets reach SIMILARITY."""
    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.filter(both >= SIMILARITY * (F.size("x") + F.size("y") - both)).select("a", "b")


def _prefixes(rows: DataFrame) -> DataFrame:
    """`rows` (node, family, shingles) -> (family, shingle, node): the shingles that a similar set of the family must share one of.

    Of a set of n, SIMILARITY * n must be shared, so n - SIMILARITY * n + 1 of its rarest suffice; those that
    no other set of the family has count among them and are left out.
    """
    tokens = rows.select("family", "node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    shared = tokens.groupBy("family", "shingle").agg(F.count("*").alias("k")).filter("k > 1")
    order, whole = Window.partitionBy("node").orderBy("k", "shingle"), Window.partitionBy("node")
    ranked = tokens.join(shared, ["family", "shingle"]).withColumn("at", F.row_number().over(order)).withColumn("common", F.count("*").over(whole))
    ranked = ranked.withColumn("at", F.col("size") - F.col("common") + F.col("at") - 1)
    return ranked.filter(F.col("at") <= F.col("size") - F.ceil(SIMILARITY * F.col("size") - 1e-9)).select("family", "shingle", "node")


def _of_several(prefixes: DataFrame, state: DataFrame) -> DataFrame:
    """(node) of the rows that have a posting in common with a row of another component."""
    held = prefixes.join(state.select("node", "component"), "node")
    ends = held.groupBy("family", "shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return held.join(ends.filter("lo < hi"), ["family", "shingle"]).select("node").distinct()


def _merged(state: DataFrame, found: DataFrame) -> DataFrame:
    """`state` (node, family, component) after the links `found` (a, b)."""
    known = state.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    roots = components(known.unionByName(found)).withColumnRenamed("component", "root")
    return written(state.join(roots, "node", "left").select("node", "family", F.coalesce("root", "component").alias("component")), "neardup-state")


def _linked(rows: DataFrame) -> DataFrame:
    """`rows` (node, family, component, shingles) -> (a, b): enough of the pairs at SIMILARITY between components of a family to join them.

    A family's largest component needs no comparison within itself, so each block of the other rows meets itself, the other
    such blocks and every block of the largest; no pair is a row. Blocks hold up to BLOCK_ROWS rows and BLOCK_SHINGLES shingles.
    """
    sized = rows.groupBy("family", "component").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("m"))
    family = sized.groupBy("family").agg(F.max(F.struct("n", "m", "component")).alias("top"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    family = family.select("family", F.col("top.component").alias("top"), F.struct("top.n", "top.m").alias("t"), F.struct((F.col("n") - F.col("top.n")).alias("n"), (F.col("m") - F.col("top.m")).alias("m")).alias("o"))
    family = family.withColumns({k: F.ceil(F.greatest(F.col(f"{k}.n") / BLOCK_ROWS, F.col(f"{k}.m") / BLOCK_SHINGLES)).cast("int") for k in ("t", "o")})
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(family.select("*", salts), ["family", "salt"])
    in_top, spread = F.col("component") == F.col("top"), F.xxhash64(F.lit("block"), "node")
    dealt = dealt.withColumn("block", F.when(in_top, F.col("o") + F.pmod(spread, "t")).otherwise(F.pmod(spread, "o")).cast("int"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    before = F.transform(F.sequence(F.lit(0), F.least(F.col("block"), F.col("o") - 1)), lambda i: pair(i, F.col("block")))
    after = F.when(F.col("block") + 1 < F.col("o") + F.col("t"), F.transform(F.sequence(F.col("block") + 1, F.col("o") + F.col("t") - 1), lambda j: pair(F.col("block"), j)))
    both = F.when(in_top | after.isNull(), before).otherwise(F.concat(before, after))
    dealt = dealt.withColumn("p", F.explode(both)).select("family", "p.i", "p.j", "block", "node", "component", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in tables(batches, 3):
            i, j = (group.column(k)[0].as_py() for k in (1, 2))
            block, node, component = (group.column(k).to_numpy() for k in (3, 4, 5))
            lists = group.column(6).combine_chunks()
            a, b = alike_between(lists.offsets.to_numpy(), lists.values.to_numpy(), component, np.flatnonzero(block == i), np.flatnonzero(block == j))
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(run, "a long, b long")


def alike_between(offsets: np.ndarray, values: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows a of `left` and b of `right` in different components whose sets reach SIMILARITY, a forest of them."""
    sets = [values[offsets[k] : offsets[k + 1]] for k in right.tolist()]
    sizes = np.array([len(x) for x in sets], np.int64)
    held, owner = np.concatenate(sets) if sets else values[:0], np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    label = np.unique(component, return_inverse=True)[1]
    a, b = [], []
    for x in left.tolist():
        own = values[offsets[x] : offsets[x + 1]]
        low = np.searchsorted(held, own)
        many = np.searchsorted(held, own, "right") - low
        places = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(owner[places], minlength=len(right))
        alike = (both >= SIMILARITY * (len(own) + sizes - both)) & (label[right] != label[x])
        for k in np.flatnonzero(alike).tolist():
            y = int(right[k])
            if label[x] != label[y]:
                label[label == label[y]] = label[x]
                a.append(x)
                b.append(y)
    return np.array(a, np.int64), np.array(b, np.int64)


def _joined(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component): the groups of all pairs at SIMILARITY inside the families that the links `met` (a, b) make."""
    family = components(met).select("node", F.col("component").alias("family"))
    state = family.withColumn("component", F.col("node"))
    state = _merged(state, _alike(met.groupBy("a").agg(F.min("b").alias("b")), sets))
    several = state.groupBy("family").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    several = several.filter("n > 2 and lo < hi").select("family", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))  # of two, the only pair is verified
    salted = state.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))  # a family can be large
    rows = written(salted.join(several, ["family", "salt"], "left_semi").select("node", "family").join(sets, "node"), "neardup-open")
    prefixes = written(_prefixes(rows), "neardup-prefixes")
    left = written(rows.join(_of_several(prefixes, state), "node").join(state.select("node", "component"), "node"), "neardup-left")
    done = _merged(state, _linked(left))
    for frame in (rows, prefixes, left, state):
        drop_written(frame)
    return done.select("node", "component")


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id (null: the least), text and a key of both."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(doc_id, F.lit(-(2**63))).alias("doc_id"), F.xxhash64(doc_id, F.coalesce(text, F.lit(""))).alias("row"), text.alias("text"), *more)


def _members(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) -> (doc_id, row, component) per row: a number of its group of near copies. Nodes are distinct sets of shingles."""
    docs = _keyed(docs)
    sigs = written(signatures(docs, "row"), "signatures")
    once = sigs.groupBy("copy").agg(F.min("row").alias("row"), *(F.first(f"s{w}").alias(f"s{w}") for w in range(WORDS)))
    distinct = written(once.withColumn("rep", F.monotonically_increasing_id()), "signatures-once")
    batches = [written(links(distinct, k, k + KEYS_AT_ONCE), "neardup-links") for k in range(0, KEYS, KEYS_AT_ONCE)]
    met = written(reduce(DataFrame.unionByName, batches).distinct(), "neardup-links")
    for batch in batches:
        drop_written(batch)
    ends = met.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = distinct.join(ends, "rep", "left_semi").select("row", F.col("rep").alias("node"))
    sets = written(_shingle_sets(docs.join(wanted, "row").dropDuplicates(["node"])), "shingles")
    roots = _joined(met, sets)
    drop_written(met)
    drop_written(sets)
    classes = distinct.join(roots, F.col("rep") == F.col("node"), "left").select("copy", F.coalesce("component", "rep").alias("component"))
    return sigs.join(classes, "copy").select("doc_id", "row", "component")


def groups(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) -> (doc_id, group_id): the smallest doc_id that a document is a near copy of, directly or not."""
    members = _members(docs)
    least = members.groupBy("component").agg(F.min("doc_id").alias("group_id"))
    return members.join(least, "component").groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns as they are, that stand for their group: one each.

    The row with the group's smallest doc_id stays, of several texts under it the one of the least key.
    """
    stay = _members(docs).groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    stay = stay.select(F.col("first.doc_id").alias("stay_id"), F.col("first.row").alias("stay_row"))
    whole = _keyed(docs, F.struct(*(docs[c] for c in docs.columns)).alias("whole")).select("doc_id", "row", "whole")
    kept = whole.join(stay, (F.col("doc_id") == F.col("stay_id")) & (F.col("row") == F.col("stay_row")), "left_semi")
    order = Window.partitionBy("doc_id", "row").orderBy(F.col("whole.text"))
    kept = kept.withColumn("k", F.row_number().over(order)).filter("k = 1")
    return kept.select(*(F.col("whole")[c].alias(c) for c in docs.columns))
