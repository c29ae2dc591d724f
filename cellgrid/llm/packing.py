"""Hierarchical multi-length packing of token sequences.

Documents are tokenised where they lie and packed inside their partition, so nothing is shuffled.
A document's full windows become sequences of their own. Its remainder is routed to the shortest
tier (256, 512, 1024 or 2048 tokens) that holds it. Longer tiers are packed first; the gap of a
window is filled with whole remainders of shorter tiers, best fit first, and closed with a cut one,
so every window is exactly full. What is left at a partition's end becomes sequences whose lengths
are powers of two, which need no padding. Sequences are then dealt to step groups so that each
group costs about the same.

Null and empty texts give the end token alone. Repeated rows are packed once each. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.cluster import bounded

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Entries of a table, and the longest part (in characters) that is kept: together they bound its memory, whatever the texts.
CACHE_ENTRIES, CACHED_BYTES = 400_000, 96
#: Bytes of text that are tokenised together, what a row adds to them, and words that are merged in one call.
TEXT_BYTES, ROW_BYTES, MERGED_AT_ONCE = 8 << 20, 64, 100
POOL_TOKENS = 128 * WINDOW
GROUP_SEQUENCES = 8

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("tier", pa.int32()), ("step_group", pa.int64())]
)

#: How the vocabulary's own file splits a lower-cased text before merging.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: The steps of a tokenizer file under which no id depends on text beyond white space.
_CHUNKED = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])


def _by_chunks(tokenizer_path: str) -> bool:
    """Whether the file's normaliser and pre-tokenizer are those that `WordIds` takes apart."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [(spec.get(k) or {}).get(v, []) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    if tuple([x["type"] for x in own] for own in steps) != _CHUNKED:
        return False
    (_, space, _), (split, letters) = steps
    return (
        (space["pattern"], space["content"]) == ({"Regex": r"\s+"}, " ")
        and (split["pattern"], split["behavior"], split["invert"]) == ({"Regex": _SPLIT.pattern}, "Removed", True)
        and not (letters["add_prefix_space"] or letters["use_regex"] or spec.get("post_processor") or spec["model"].get("continuing_subword_prefix"))
        and not any(c.isspace() for t in spec["added_tokens"] for c in t["content"])
    )


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _latin_split() -> str:
    """`_SPLIT` for lower-cased texts of `_LATIN` characters, with its classes spelled out for Arrow's RE2."""
    known = [chr(c) for c in (*range(33, 127), *range(161, 256))]
    letters, digits = ("".join(c for c in known if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}"))
    return rf"('s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{letters}{digits} ]+)"


#: Short chunks of Latin-1 without controls and odd spaces: composed already, and lower-cased letter by letter.
_LATIN = "^[!-~\xa1-\xff]{1,199}$"
_LATIN_SPLIT = _latin_split()


class WordIds(dict):
    """Part of a text -> its token ids as little-endian 32-bit bytes. Parts are words as the vocabulary's
    file splits them and, where a chunk between ASCII white space is not `_LATIN`, whole chunks.

    Where no token and no normalisation step of a vocabulary spans white space, a text's ids are those
    of its chunks in turn; that is so if its file has the steps of `_CHUNKED`, which is looked up, and
    any other file is encoded text by text. Many texts are taken at once: Arrow finds their different
    chunks and the different words of these, the table is asked for each word once, new words are
    merged in runs, and the texts' ids are gathered by number. The table forgets everything when it is full.
    """

    def __init__(self, tokenizer_path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        self.chunked = _by_chunks(tokenizer_path)
        self.entries = entries
        self.pretokens = self
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # whether an id ends a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text (None: empty), without the end token."""
        return self.encode_all(pa.array([(text or "").encode("utf-8", "replace").decode()]))[0]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each of the whole `texts` (null: empty), without the end token."""
        if not self.chunked:
            return [np.asarray(self.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4") for t in texts.to_pylist()]
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = pc.dictionary_encode(chunks.values)
        ids, sizes = self._chunk_ids(coded.dictionary)
        ids, ends = _runs(ids, sizes, coded.indices.to_numpy())
        edges = ends[chunks.offsets.to_numpy()].tolist()
        return [ids[at:end] for at, end in zip(edges, edges[1:], strict=False)]

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks, one after another, and the number of each."""
        latin = pc.match_substring_regex(chunks, _LATIN)
        spaced = pc.replace_substring_regex(pc.utf8_lower(chunks.filter(latin)), _LATIN_SPLIT, r"\1 ")
        parts = pc.split_pattern(pc.ascii_rtrim_whitespace(spaced), " ")
        coded = pc.dictionary_encode(parts.values)
        words = self._looked_up(_objects(coded.dictionary), self._merged)
        ids, ends = _runs(*_joined(words), coded.indices.to_numpy())
        others = [c.decode("utf-8", "replace") for c in _objects(chunks.filter(pc.invert(latin)).cast(pa.large_binary()))]
        rest, rest_sizes = _joined(self._looked_up(others, self._encoded))
        sizes = np.concatenate((np.diff(ends[parts.offsets.to_numpy()]), rest_sizes))
        is_latin = latin.to_numpy(zero_copy_only=False)
        place = np.where(is_latin, np.cumsum(is_latin) - 1, is_latin.sum() + np.cumsum(~is_latin) - 1)
        return _runs(np.concatenate((ids, rest)), sizes, place)[0], sizes[place]

    def _looked_up(self, parts: list[str], compute: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        found = list(map(self.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        if len(self) + len(new) > self.entries:
            self.clear()
        for at in range(0, len(new), MERGED_AT_ONCE):
            some = new[at : at + MERGED_AT_ONCE]
            for i, ids in zip(some, compute([parts[i] for i in some]), strict=True):
                found[i] = ids
                if len(parts[i]) <= CACHED_BYTES and len(self) < self.entries:
                    self[parts[i]] = ids
        return found

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        return [np.asarray(self.tokenizer.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes() for c in chunks]

    def _merged(self, words: list[str]) -> list[bytes]:
        """The ids of words of `_LATIN` characters, merged in one call and told apart by the tokens that end a word."""
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        ids = np.asarray(self.merges.encode(" ".join(spelled), add_special_tokens=False).ids, dtype="<u4")
        ends = [0, *(4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()]
        raw = ids.tobytes()
        if len(words) > 1 and len(ends) != len(words) + 1:  # a vocabulary that lacks an ending
            return [ids for w in words for ids in self._merged([w])]
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)] if len(words) > 1 else [raw]


def _objects(strings: pa.Array) -> list:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the number of each."""
    return np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _runs(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`flat` holds runs of `sizes`: the runs of these numbers, one after another, and 0 and the end of each."""
    starts, taken = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.concatenate(([0], np.cumsum(taken)))
    kind = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts[codes] - ends[:-1]).astype(kind), taken)
    at += np.arange(ends[-1], dtype=kind)
    return flat[at], ends


@lru_cache(maxsize=2)
def word_ids(tokenizer_path: str) -> WordIds:
    """One table a worker process."""
    return WordIds(tokenizer_path)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in order, in groups of some TEXT_BYTES of text, or of one longer text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64) + ROW_BYTES)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + (not held), int(np.searchsorted(ends, before + TEXT_BYTES - size, "right")))
            held.append(batch.slice(at, end - at))
            size += int(ends[end - 1]) - before if end else 0
            if end < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
            at = end
    if held:
        yield pa.concat_batches(held)


class Packer:
    """Packs one partition's documents; `rows` takes the finished pieces."""

    def __init__(self, partition: int):
        self.base = partition << 36
        self.sequences = 0
        self.groups = 0
        self.pool: list[tuple] = []
        self.held = 0
        self.open: list[tuple[int, list]] = []  # (tier, pieces) of finished sequences not yet dealt
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total = len(ids)
        full = total - total % WINDOW
        for at in range(0, full, WINDOW):
            self.open.append((WINDOW, [(doc_id, at, ids[at : at + WINDOW], total)]))
        if full < total:
            self.pool.append((doc_id, full, ids[full:].copy(), total))
            self.held += total - full
        if self.held >= POOL_TOKENS:
            self._pack()
        if len(self.open) >= 512:
            self._deal()

    def finish(self) -> None:
        self._pack()
        queue, left = self.pool[::-1], self.held
        self.pool, self.held = [], 0
        while left:  # powers of two, largest first
            size = min(WINDOW, 1 << (left.bit_length() - 1))
            self.open.append((next(t for t in TIERS if t >= size), self._take(queue, size)))
            left -= size
        self._deal()

    @staticmethod
    def _take(queue: list[tuple], size: int) -> list[tuple]:
        """Pieces of exactly `size` tokens off the end of `queue`, the last one cut where needed."""
        out = []
        while size:
            doc_id, start, ids, total = queue.pop()
            if len(ids) > size:
                queue.append((doc_id, start + size, ids[size:], total))
                ids = ids[:size]
            out.append((doc_id, start, ids, total))
            size -= len(ids)
        return out

    def _pack(self) -> None:
        """Windows of each tier, the longest first; what fills no window any more stays in the pool."""
        items = sorted(self.pool, key=lambda p: len(p[2]))
        sizes = [len(p[2]) for p in items]
        left = sum(sizes)
        for tier, floor in zip(TIERS[::-1], (*TIERS[-2::-1], 0), strict=True):
            while sizes and floor < sizes[-1] <= tier and left >= tier:
                pieces = [items.pop()]
                gap = tier - sizes.pop()
                while gap:
                    at = bisect_right(sizes, gap) - 1
                    if at >= 0:  # the largest that fits whole
                        pieces.append(items.pop(at))
                        gap -= sizes.pop(at)
                        continue
                    doc_id, start, ids, total = items.pop(0)  # none fits: cut the shortest
                    sizes.pop(0)
                    pieces.append((doc_id, start, ids[:gap], total))
                    at = bisect_right(sizes, len(ids) - gap)
                    items.insert(at, (doc_id, start + gap, ids[gap:], total))
                    insort(sizes, len(ids) - gap)
                    gap = 0
                self.open.append((tier, pieces))
                left -= tier
        self.pool, self.held = items, left

    def _deal(self) -> None:
        """Numbers the sequences and deals each tier's to step groups, costliest first, back and forth."""
        for tier in TIERS:
            own = [p for t, p in self.open if t == tier]
            own.sort(key=lambda pieces: -sum(len(p[2]) ** 2 for p in pieces))
            groups = max(1, -(-len(own) // GROUP_SEQUENCES))
            for i, pieces in enumerate(own):
                lap, step = divmod(i, groups)
                group = self.base + self.groups + (groups - 1 - step if lap % 2 else step)
                offset = 0
                for doc_id, start, ids, total in pieces:
                    self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.base + self.sequences, offset, tier, group))
                    offset += len(ids)
                self.sequences += 1
            self.groups += groups if own else 0
        self.open = []

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in _ARROW]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """`docs` (doc_id, text) packed into sequences of at most WINDOW tokens; a row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId())
        end = np.array([END_ID], dtype="<u4")
        for group in _groups(batches):
            for doc_id, ids in zip(group.column(0).to_pylist(), words.encode_all(group.column(1)), strict=True):
                packer.add(doc_id, np.concatenate((ids, end)))
            if len(packer.rows) >= 10_000:
                yield packer.drain()
        packer.finish()
        yield packer.drain()

    source = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)
