"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 so that one Aho-Corasick automaton over the vocabulary finds, in one
pass, the longest token that starts at each place of a pre-token. Encoding walks left to right with
the longest token, takes the next shorter prefix when the token is incompatible with the one before
it, and steps back when none is left; places found to be dead ends are never entered again, so the
walk is linear. Two adjacent tokens are compatible if the merges of their joined bytes give back
just these two; the answer is memoised per pair. A sequence all of whose neighbours are compatible
is the one that the merges produce, so the result equals merging by rank.

Null and empty texts have no ids. Repeated rows are encoded once each; texts of any length are read
whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.cluster import bounded

#: Entries of a cache, and the longest chunk that is kept: together they bound its memory, whatever the texts.
CACHE_ENTRIES, CACHED_CHARS = 400_000, 48
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: White space as the vocabulary's pattern sees it; Python's own class has four controls more.
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A run without white space with the one space before it, or what a run of white space leaves.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int = CACHE_ENTRIES):
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.split = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.entries = entries
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int | None] = {}
        sound = {t: r for t, r in ranks.items() if self._merged(t) == [r]}  # that merging can produce
        for token, rank in sound.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            self.shorter[rank] = next((sound[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in sound), None)
        self.automaton.make_automaton()

    def _merged(self, piece: bytes) -> list[int]:
        """The merges of a few bytes, lowest rank first, leftmost among equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= 4 * self.entries:
                self.pairs.clear()
            known = self.pairs[left, right] = self._merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        longest: list[int | None] = [None] * (len(piece) + 1)
        for end, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = rank  # ends grow, so the longest comes last
        alive = bytearray(b"\1" * (len(piece) + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            last = out[-1] if out else None
            while token is not None:
                end = at + len(self.bytes_of[token])
                if alive[end] and (last is None or self._compatible(last, token)):
                    break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at, token = end, longest[end]
            else:
                if last is None:
                    raise ValueError("the vocabulary lacks a single byte of this text")
                alive[at] = 0
                token = out.pop()
                at -= len(self.bytes_of[token])
        return out

    def _chunk(self, chunk: str) -> bytes:
        ids = b"".join(map(self._piece, self.split.findall(chunk)))
        if len(chunk) <= CACHED_CHARS:
            if len(self.chunks) >= self.entries:
                self.chunks.clear()
            self.chunks[chunk] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = np.asarray(self.encode_piece(piece.encode("utf-8", "replace")), dtype="<u4").tobytes()
            if len(piece) <= CACHED_CHARS:
                if len(self.pieces) >= self.entries:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text, None for the empty one."""
        known, miss = self.chunks.get, self._chunk
        return np.frombuffer(b"".join([known(c) or miss(c) for c in _CHUNK.findall(text or "")]), dtype="<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.asarray(ids).tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec a worker process."""
    return ByteBpe(load_ranks(path), pattern)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row of `docs` (doc_id, text): the number and digest of its ids, and the digest of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                counts.append(len(ids))
                encoded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)
