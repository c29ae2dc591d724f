"""Toxicity from subword bags: character n-gram vectors averaged into a linear softmax.

A word is the bag of its character 3- to 5-grams with its edges marked, hashed to a table of
vectors; a span of words is the average of its words' vectors, and a softmax over two classes reads
it. Vectors and softmax are trained jointly by Adagrad in numpy. Misspelt or inflected words that
were never seen share n-grams with those that were.

A few words decide whether a long text is toxic, so a text's score is that of its worst span of
SPAN words. Labels mark texts, not spans: training starts from all spans of toxic texts and then,
round by round, keeps those that the model itself finds worst, against random and worst spans of
clean texts.

Only whole texts are scored, and only `text` is an input. Null and empty texts are scored as an
empty span. Labelled ids that no text has, or with a null label, are left out. With no labelled
rows of both classes every score is 0.0. Repeated rows are scored once each; of several texts under
one labelled id the least is learned, of several labels the greater. Other columns are kept as they
are by `keep_clean` and ignored by `score`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.cluster import bounded

#: The documented bound of the training sample: labelled documents of each class, by least hash of their id.
MAX_TOXIC, MAX_CLEAN = 1500, 2500
#: Clean spans drawn for one round, and spans kept of each toxic text after the first round.
CLEAN_SPANS, KEPT_SPANS = 20_000, 2
THRESHOLD = 0.7
SPAN, STRIDE = 8, 4
GRAMS = (3, 4, 5)
BUCKETS, DIM = 1 << 17, 12
ROUNDS, BATCH, RATE = 5, 256, 0.15
CACHE_ENTRIES = 200_000
_MARKS = ".,;:!?|\"'()[]{}<>*#$%&+-=_~/\\"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without the marks around them, and without those that repeat one of the last few: a span has a word once."""
    out: list[str] = []
    for x in (text or "").lower().split():
        w = x.strip(_MARKS)
        if w and w not in out[1 - SPAN :]:
            out.append(w)
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of each character n-gram of `words`."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # letters from here to the word's end
    owners, buckets = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ codes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        owners.append(owner[at])
        buckets.append((h % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def spans_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of spans of SPAN words, each STRIDE after the last, up to the text's end."""
    begin = np.arange(0, max(1, n - SPAN + STRIDE), STRIDE)
    return begin, np.minimum(n, begin + SPAN)


def gram_table(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' n-grams in order of word, where each word's begin), made in parts to bound memory."""
    parts, counts = [], []
    for at in range(0, len(words), at_once):
        part = words[at : at + at_once]
        owner, bucket = grams(part)
        parts.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(part)))
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


class Model:
    """A bucket's share of the toxic class's margin, and the bias: all that scoring needs."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {"table": self.table, "bias": self.bias, "known": {}}

    def word_margins(self, words: list[str]) -> np.ndarray:
        owner, bucket = grams(words)
        total = np.bincount(owner, self.table[bucket], len(words))
        return total / np.maximum(1, np.bincount(owner, minlength=len(words)))

    def margins(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > CACHE_ENTRIES:
            known.clear()
            new = list(dict.fromkeys(words))
        if new:
            known.update(zip(new, self.word_margins(new).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def score(self, text: str | None) -> float:
        words = words_of(text)
        worst = 0.0
        if words:
            sums = np.concatenate(([0.0], np.cumsum(self.margins(words))))
            begin, end = spans_of(len(words))
            worst = float((sums[end] - sums[begin]).max()) / SPAN
        return float(1 / (1 + np.exp(-np.clip(worst + self.bias, -50, 50))))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """A model of labelled texts."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    if not vocabulary or len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -50.0)
    bucket, first = gram_table(list(vocabulary))
    vectors = np.zeros((BUCKETS, DIM), np.float32)  # an n-gram never seen says nothing
    heads, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    speed_v, speed_h, speed_b = np.full((BUCKETS, 1), 1e-6, np.float32), np.full_like(heads, 1e-6), np.full_like(bias, 1e-6)
    text = np.concatenate(docs)
    places = [spans_of(len(d)) for d in docs]
    base = np.cumsum([0] + [len(d) for d in docs[:-1]])
    doc = np.repeat(np.arange(len(docs)), [len(p[0]) for p in places])
    begin = np.concatenate([p[0] + at for p, at in zip(places, base, strict=True)])
    size = np.concatenate([p[1] - p[0] for p in places])
    label = np.asarray(labels)[doc]
    toxic, clean = np.flatnonzero(label == 1), np.flatnonzero(label == 0)

    def step(rows: np.ndarray) -> None:
        sizes = size[rows]
        span = np.repeat(np.arange(len(rows)), sizes)
        inside = np.arange(len(span)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        used, place = np.unique(text[np.repeat(begin[rows], sizes) + inside], return_inverse=True)
        count = first[used + 1] - first[used]
        word = np.repeat(np.arange(len(used)), count)
        at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[used], count)
        cells = bucket[at]
        mean_word = np.zeros((len(used), DIM), np.float32)
        np.add.at(mean_word, word, vectors[cells])
        mean_word /= np.maximum(1, count)[:, None]
        mean = np.zeros((len(rows), DIM), np.float32)
        np.add.at(mean, span, mean_word[place])
        share = np.float32(1 / SPAN)
        mean *= share
        odds = mean @ heads + bias
        odds = np.exp(odds - odds.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        slope = odds
        slope[np.arange(len(rows)), label[rows]] -= 1
        slope_h, slope_b = mean.T @ slope / len(rows), slope.mean(axis=0)
        back = slope @ heads.T * share / len(rows)
        back_word = np.zeros((len(used), DIM), np.float32)
        np.add.at(back_word, place, back[span])
        back_word /= np.maximum(1, count)[:, None]
        cell, inverse = np.unique(cells, return_inverse=True)
        slope_v = np.zeros((len(cell), DIM), np.float32)
        np.add.at(slope_v, inverse, back_word[word])
        speed_v[cell] += (slope_v**2).mean(axis=1, keepdims=True)
        vectors[cell] -= RATE * slope_v / np.sqrt(speed_v[cell])
        np.add(speed_h, slope_h**2, out=speed_h)
        np.add(speed_b, slope_b**2, out=speed_b)
        heads[...] -= RATE * slope_h / np.sqrt(speed_h)
        bias[...] -= RATE * slope_b / np.sqrt(speed_b)

    def model() -> Model:
        return Model(vectors @ (heads[:, 1] - heads[:, 0]), float(bias[1] - bias[0]))

    def worst(rows: np.ndarray, keep: int) -> np.ndarray:
        """The `keep` worst spans of each text among `rows`, as the model sees them now."""
        now = model().table.astype(np.float32)
        sums = np.concatenate(([0.0], np.cumsum(now[bucket], dtype=np.float64)))
        margin = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, np.diff(first))
        sums = np.concatenate(([0.0], np.cumsum(margin[text])))
        value = sums[begin[rows] + size[rows]] - sums[begin[rows]]
        order = np.lexsort((-value, doc[rows]))
        ranked = rows[order]
        texts_at = doc[ranked]
        new = np.concatenate(([True], texts_at[1:] != texts_at[:-1]))
        rank = np.arange(len(ranked)) - np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
        return ranked[rank < keep]

    for turn in range(ROUNDS):
        some = rng.choice(clean, min(CLEAN_SPANS, len(clean)), replace=False)
        if turn == 0:
            bad = toxic if len(toxic) <= CLEAN_SPANS else rng.choice(toxic, CLEAN_SPANS, replace=False)
        else:
            bad, some = worst(toxic, KEPT_SPANS), np.concatenate((some, worst(clean, 2)))
            bad = np.tile(bad, max(1, min(4, len(some) // (2 * len(bad)))))
        rows = rng.permutation(np.concatenate((bad, some)))
        for at in range(0, len(rows), BATCH):
            step(rows[at : at + BATCH])
    return model()


def training_rows(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """The bounded sample (text, toxic) of labelled rows outside the held-out third."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    spread = F.xxhash64(F.lit("toxicity sample"), "doc_id")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [own.filter(F.col("toxic") == k).orderBy(spread, "doc_id").limit(n) for k, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    sample = picked[0].unionByName(picked[1])  # at most MAX_TOXIC + MAX_CLEAN ids, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def in_held_out(doc_id):
    """crc32 of the id as text leaves 1 when divided by three."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = training_rows(docs, labels, in_held_out).orderBy("doc_id").toPandas()
    return train(sample["text"].tolist(), sample["toxic"].tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    source = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(in_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text is not predicted toxic."""
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py()) < THRESHOLD for t in batch.column(at)], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
