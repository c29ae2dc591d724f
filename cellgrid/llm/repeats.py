"""Removal of every long byte string that occurs twice, by suffix arrays.

A suffix array over the whole corpus would need the corpus in one place. Here each LENGTH-byte
string is routed by its minimiser, the least hash among the GRAM-byte strings in it: equal strings
have equal minimisers, so all places of a string meet in one shard. Neighbouring strings with the
same minimiser travel as one run of text. Runs whose minimiser occurs once in the corpus hold no
repeat and go no further; runs with equal bytes (128-bit digest) are counted and sent once, so a
group of copies of any size costs one run. Runs that share a minimiser but differ are compared:

* a shard's texts are concatenated and its suffix array is built by Larsson-Sadakane refinement,
* common prefixes of neighbouring suffixes follow by Kasai's rule,
* a group of runs that spans shards is merged by binary search of one shard's sorted strings in the
  other's. A group too large for one task is split by salt and its strings meet once more by digest.

Matches never cross documents. A null text is the empty one and loses nothing, nor does a text
under LENGTH bytes. Rows that repeat another row's text, with the same or another doc_id, lose all
of their strings like any copies do; rows are told apart by doc_id and text together. Long texts are
cut into runs of bounded size and read whole. Other columns are kept as they are by `remove`, whatever
their names, and ignored by `report`. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.cluster import bounded, drop_written, written

LENGTH = 200
GRAM = 32
#: Starts in one run at most, text of one shard, and differing runs of one minimiser that one task takes.
RUN_STARTS = 512
SHARD_BYTES = 1 << 20
GROUP_RUNS = 4096
_BLOCK_BYTES = 1 << 18


def _mixed_bytes() -> np.ndarray:
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_BYTES = _mixed_bytes()


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) over each `width` neighbouring values."""
    k = 1
    while 2 * k <= width:
        values = pick(values[:-k], values[k:])
        k *= 2
    return pick(values[: len(values) - (width - k)], values[width - k :]) if width > k else values


def minimisers(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of the `gram`-byte strings in each string of `length` bytes, and each one's hash. gram: a power of two."""
    h, k = _BYTES[data], 1
    while k < gram:
        h = h[:-k] * np.uint64(0xD6E8FEB86659FD93 + 2 * k) + h[k:]
        k *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return _sliding(h, length - gram + 1, np.minimum), h


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text's number, start in it, starts, minimiser, digest as two longs, weight) of each run of strings with one minimiser.

    The weight is 2 where the text holds the minimiser at more than one place, so that a run may repeat itself.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = b"".join(texts)
    if len(joined) < length:
        return tuple(np.empty(0, np.int64) for _ in range(7))
    key, hashes = minimisers(np.frombuffer(joined, np.uint8), length, gram)
    begin = np.cumsum(sizes) - sizes
    cut = np.zeros(len(key) + 1, bool)
    cut[0] = True
    cut[1:-1] = key[1:] != key[:-1]
    inside = sizes >= length
    cut[begin[inside]] = True
    close = begin + sizes - length + 1  # the first place of each text from which no string starts inside it
    cut[np.minimum(close[inside], len(key))] = True
    heads = np.flatnonzero(cut[:-1])
    counts = np.diff(np.append(heads, len(key)))
    owner = np.searchsorted(begin, heads, side="right") - 1
    keep = (heads < close[owner]) & inside[owner]
    heads, counts, owner = heads[keep], counts[keep], owner[keep]
    if len(counts) and counts.max() > RUN_STARTS:
        parts = -(-counts // RUN_STARTS)
        lap = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        rest = np.repeat(counts, parts) - lap * RUN_STARTS
        heads, owner, counts = np.repeat(heads, parts) + lap * RUN_STARTS, np.repeat(owner, parts), np.minimum(rest, RUN_STARTS)
    pad = np.zeros(length - gram, np.uint64)
    chosen = np.flatnonzero(hashes == _sliding(np.concatenate((pad, key, pad)), length - gram + 1, np.maximum))
    where = np.searchsorted(begin, chosen, side="right") - 1
    order = np.lexsort((where, hashes[chosen]))
    value, where = hashes[chosen][order], where[order]
    again = np.flatnonzero((value[1:] == value[:-1]) & (where[1:] == where[:-1]))
    twice = np.isin(key[heads], value[again])
    digest = xxhash.xxh3_128_digest
    ends = heads + counts + (length - 1)
    digests = b"".join([digest(joined[a:b]) for a, b in zip(heads.tolist(), ends.tolist(), strict=True)])
    pairs = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return owner, heads - begin[owner], counts, key[heads].view(np.int64), pairs[:, 0].copy(), pairs[:, 1].copy(), 1 + twice


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes with the suffix before, of `symbols` from 0 to 256.

    Refinement after Larsson and Sadakane: suffixes start sorted by their first seven symbols; each
    round doubles the depth and sorts only groups that are still undecided. Prefixes after Kasai: a
    place whose predecessor symbols agree has one symbol less in common than the place before it,
    so only the other places are compared.
    """
    n = len(symbols)
    padded = np.concatenate((symbols.astype(np.int64) + 1, np.zeros(7, np.int64)))
    packed = np.zeros(n, np.int64)
    for i in range(7):
        packed = (packed << 9) | padded[i : i + n]
    array = np.argsort(packed, kind="stable")
    new = np.concatenate(([True], packed[array][1:] != packed[array][:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[array] = head
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    depth = 7
    while len(slots):
        at = array[slots]
        key = rank[at] * (n + 2) + rank[np.minimum(at + depth, n)] + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        array[slots] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        depth *= 2
    before = np.full(n, -1)
    before[array[1:]] = array[:-1]
    place = np.arange(n)
    same = np.zeros(n, bool)
    inner = (before > 0) & (place > 0)
    same[inner] = symbols[place[inner] - 1] == symbols[before[inner] - 1]
    same[0] = False
    start = np.flatnonzero(~same & (before >= 0))
    common = np.zeros(n, np.int64)
    packed = np.append(packed, [-1] * 8)
    live, other, got = start, before[start], np.zeros(len(start), np.int64)
    while len(live):
        equal = packed[np.minimum(live + got, n)] == packed[np.minimum(other + got, n + 1)]
        equal &= (live + got < n) & (other + got < n)
        common[live[~equal]] = got[~equal]
        live, other, got = live[equal], other[equal], got[equal] + 7
    tail, mate = start, before[start]
    for _ in range(6):
        a, b = tail + common[tail], mate + common[tail]
        more = (a < n) & (b < n)
        more[more] = symbols[a[more]] == symbols[b[more]]
        tail, mate = tail[more], mate[more]
        common[tail] += 1
    base = np.maximum.accumulate(np.where(same, 0, place))
    common = np.where(before >= 0, np.maximum(common[base] - (place - base), 0), 0)
    return array, common[array]


class Shards:
    """Runs of one task, sorted by group, in shards; says which starts of each run repeat."""

    def __init__(self, length: int = LENGTH, shard_bytes: int = SHARD_BYTES):
        self.length, self.shard_bytes = length, shard_bytes
        self.held: list[tuple] = []  # (group, tag, text, starts)
        self.size = 0
        self.group = None  # the group that the last shard left open
        self.open: list[tuple] = []  # its runs so far: (tag, text, found)
        self.tables: list[tuple] = []  # its shards so far: (sorted strings, found arrays and places)

    def add(self, group, tag, text: bytes, starts: int, repeated: bool) -> Iterator[tuple]:
        self.held.append((group, tag, text, np.full(starts, repeated)))
        self.size += len(text)
        if self.size >= self.shard_bytes:
            yield from self._shard()

    def finish(self) -> Iterator[tuple]:
        yield from self._shard()
        yield from self._close()

    def _close(self) -> Iterator[tuple]:
        yield from self.open
        self.group, self.open, self.tables = None, [], []

    def _shard(self) -> Iterator[tuple]:
        """(tag, text, found) of runs whose group is complete."""
        held, self.held, self.size = self.held, [], 0
        if not held:
            return
        length = self.length
        sizes = np.array([len(h[2]) for h in held])
        joined = np.frombuffer(b"".join([h[2] + b"\0" for h in held]), np.uint8)
        symbols = joined.astype(np.int16) + 1
        ends = np.cumsum(sizes + 1) - 1
        symbols[ends] = 0
        array, common = suffix_array(symbols)
        owner = np.searchsorted(ends, array, side="left")
        room = ends[owner] - array >= length
        joint = np.flatnonzero((common >= length) & room)  # a string equal to the one before it in order
        repeated = np.zeros(len(joined), bool)
        repeated[array[joint]] = True
        repeated[array[joint - 1]] = True
        begins = ends - sizes
        for (_, _, _, found), a in zip(held, begins.tolist(), strict=True):
            found |= repeated[a : a + len(found)]
        # a string equal to one of a run that has copies elsewhere repeats already, by its neighbour here
        for part in self._parts(held):
            group = held[part[0]][0]
            if group != self.group:
                yield from self._close()
                self.group = group
            lone = part[-1] != len(held) - 1 and not self.open
            if not lone:
                self._merge(held, part, joined, array, owner, room, begins)
            self.open += [held[i][1:] for i in part]
            if part[-1] != len(held) - 1:
                yield from self._close()

    @staticmethod
    def _parts(held: list[tuple]) -> Iterator[list[int]]:
        part: list[int] = []
        for i, h in enumerate(held):
            if part and held[part[-1]][0] != h[0]:
                yield part
                part = []
            part.append(i)
        yield part

    def _merge(self, held, part, joined, array, owner, room, begins) -> None:
        """Binary search between this shard's strings of the open group and each earlier shard's."""
        mine = room & (owner >= part[0]) & (owner <= part[-1])
        places = array[mine]
        if not len(places):
            return
        strings = np.lib.stride_tricks.sliding_window_view(joined, self.length)[places]
        strings = np.ascontiguousarray(strings).view(f"S{self.length}").ravel()
        runs_here = [(held[o][3], int(p - begins[o])) for p, o in zip(places.tolist(), owner[mine].tolist(), strict=True)]
        for other, runs_there in self.tables:
            for left, left_runs, right in ((strings, runs_here, other), (other, runs_there, strings)):
                at = np.minimum(np.searchsorted(right, left), len(right) - 1)
                for i in np.flatnonzero(right[at] == left).tolist():
                    found, start = left_runs[i]
                    found[start] = True
        self.tables.append((strings, runs_here))


_RUN_SCHEMA = "h long, d1 long, d2 long, doc_id long, row long, start int, n int, weight int"


def _runs(docs: DataFrame) -> DataFrame:
    """A row for each run of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(i).to_pylist() for i in (0, 1))
            for part in _blocks(batch.column(2)):
                texts = [batch.column(2)[i].as_py() or b"" for i in part]
                owner, start, count, key, d1, d2, weight = runs(texts)
                own = [part[o] for o in owner.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(d1), pa.array(d2), pa.array([ids[i] for i in own], pa.int64()), pa.array([rows[i] for i in own], pa.int64())]
                    + [pa.array(x.astype(np.int32)) for x in (start, count, weight)],
                    names=["h", "d1", "d2", "doc_id", "row", "start", "n", "weight"],
                )

    return bounded(docs).select("doc_id", "row", F.col("text").cast("binary").alias("text")).mapInArrow(run, _RUN_SCHEMA)


def _blocks(column: pa.Array) -> Iterator[list[int]]:
    """Numbers of a batch's rows, in blocks whose arrays stay in the processor's cache."""
    part, size = [], 0
    for i, value in enumerate(column):
        part.append(i)
        size += len(value.as_buffer()) if value.is_valid else 0
        if size >= _BLOCK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` runs with their bytes, cut from their documents."""
    schema = "h long, salt int, split boolean, doc_id long, row long, start int, n int, repeated boolean, piece binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc_id, row, text, items in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = text.as_py()
                for x in items.as_py():
                    values = (x["h"], x["salt"], x["split"], doc_id.as_py(), row.as_py(), x["start"], x["n"], x["repeated"])
                    for column, value in zip(out, (*values, data[x["start"] : x["start"] + x["n"] + LENGTH - 1]), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            names = ["h", "salt", "split", "doc_id", "row", "start", "n", "repeated", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    items = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("h", "salt", "split", "start", "n", "repeated")).alias("items"))
    texts = docs.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("text").cast("binary").alias("text"))
    joined = items.join(texts, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return joined.select("doc_id", "row", "text", "items").mapInArrow(run, schema)


def _compared(pieces: DataFrame) -> DataFrame:
    """Spans of starts that repeat among runs with one minimiser, and the strings of groups that were split."""
    schema = "doc_id long, row long, spans array<struct<a:int,b:int>>, strings array<struct<s1:long,s2:long,at:int>>"
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    string = pa.list_(pa.struct([("s1", pa.int64()), ("s2", pa.int64()), ("at", pa.int32())]))

    def row(tag, text: bytes, found: np.ndarray) -> tuple:
        doc_id, key, start, split, repeated = tag
        spans = [] if repeated else _spans(found, start)
        strings = []
        if split:  # all strings of a split group meet by digest; those known to repeat only to be met
            for i, known in enumerate(found.tolist()):
                s1, s2 = np.frombuffer(xxhash.xxh3_128_digest(text[i : i + LENGTH]), "<i8").tolist()
                strings.append({"s1": s1, "s2": s2, "at": -1 if known or repeated else start + i})
        return doc_id, key, spans, strings

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), span, string)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "row", "spans", "strings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards()
        for batch in batches:
            rows = []
            for h, salt, split, doc_id, key, start, n, repeated, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [row(*x) for x in shards.add((h, salt), (doc_id, key, start, split, repeated), piece, n, repeated)]
            yield batch_of(rows)
        yield batch_of([row(*x) for x in shards.finish()])

    return pieces.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(run, schema)


def _spans(found: np.ndarray, start: int) -> list[dict]:
    """Byte spans that repeated starts cover."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], found, [False])).astype(np.int8)))
    return [{"a": int(a) + start, "b": int(b) + start + LENGTH - 1} for a, b in edge.reshape(-1, 2)]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, row, text) -> doc_id, row, spans: byte spans [a, b) covered by repeated strings; rows without any are left out."""
    every = written(_runs(docs), "runs")
    often = every.groupBy("h").agg(F.sum("weight").alias("k")).filter("k > 1").select("h")
    held = written(every.join(often, "h", "left_semi"), "runs-met")
    drop_written(every)
    classes = held.groupBy("h", "d1", "d2").agg(
        F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("doc_id", "row", "start", "n", "weight"))
    )
    classes = written(classes, "run-classes")
    kinds = classes.groupBy("h").agg(F.count("*").alias("kinds"), F.max("weight").alias("most")).filter("kinds > 1 or most > 1")
    salts = F.ceil(F.col("kinds") / GROUP_RUNS).cast("int")
    differ = classes.join(kinds, "h").filter("kinds > 1 or copies = 1").select(
        "h", F.pmod(F.col("d1"), salts).cast("int").alias("salt"), (salts > 1).alias("split"), "doc_id", "row", "start", "n", (F.col("copies") > 1).alias("repeated")
    )
    compared = written(_compared(_texts(docs, differ)), "runs-compared")
    one = compared.filter(F.size("spans") > 0).select("doc_id", "row", F.explode("spans").alias("s"))
    met = compared.filter(F.size("strings") > 0).select("doc_id", "row", F.explode("strings").alias("x")).select("doc_id", "row", "x.*")
    again = met.groupBy("s1", "s2").agg(F.count("*").alias("k")).filter("k > 1")
    split = met.filter("at >= 0").join(again, ["s1", "s2"]).select("doc_id", "row", F.struct(F.col("at").alias("a"), (F.col("at") + LENGTH).alias("b")).alias("s"))
    copied = held.join(classes.filter("copies > 1").select("h", "d1", "d2"), ["h", "d1", "d2"]).select(
        "doc_id", "row", F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + LENGTH - 1).alias("b")).alias("s")
    )
    spans = written(copied.unionByName(one).unionByName(split).groupBy("doc_id", "row").agg(F.collect_list("s").alias("spans")), "spans")
    for frame in (held, classes, compared):
        drop_written(frame)
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal spans, in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text and a key of both."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), text.alias("text"), *more)


def _with_spans(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """The rows of `keyed` with their spans (null: none)."""
    found = repeated_spans(docs).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "spans")
    return keyed.join(found, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").drop("d", "r")


def report(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): sizes, number of removed spans and digest of the bytes kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data, cut = text.as_py(), merged(spans.as_py())
                rows.append((len(data), sum(b - a for a, b in cut), len(cut), hashlib.sha256(without(data, cut)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed = _keyed(docs)
    rows = _with_spans(keyed, keyed).select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """`docs`, all rows and columns, without repeated strings in `text`; `n_chars`, where there is one, counts what is left.

    A character of which only some bytes would go goes as a whole. A null text stays null.
    """
    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        clean: Callable = lambda t, s: without(t.encode("utf-8", "replace"), merged([{"a": x["a"], "b": x["b"]} for x in s])).decode("utf-8", "ignore")
        return pd.Series([t if t is None or s is None or not len(s) else clean(t, s) for t, s in zip(text, spans, strict=True)])

    keyed = _keyed(docs, F.struct(*(docs[c] for c in docs.columns)).alias("whole"))
    rows = _with_spans(keyed.select("doc_id", "row", "text"), keyed.select("doc_id", "row", "whole"))
    rows = rows.select("whole", cut(F.col("whole.text"), F.col("spans")).alias("left"))
    left = {"text": F.col("left"), "n_chars": F.char_length("left").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return rows.select(*(left.get(c, F.col("whole")[c]).alias(c) for c in docs.columns))
