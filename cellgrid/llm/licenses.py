"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Lines that hold a licence's cue words are compared with the templates of headers, alone and joined
with a line on each side; long lines are taken sentence by sentence. Runs of lines with cues close to
each other, of any length up to the whole document, are compared with the licence texts themselves.
Terms are weighed by their inverse frequency over the lines of the whole corpus, so common words of a
template count little. A document's own licence is that of its most similar text, else header. A
document at least half of whose letters lie in matching lines and runs, summed, is a licence file: its
licence holds for its directory. Documents without a licence of their own take that of the nearest
ancestor directory that has one; ancestors are reached by joining paths level by level.

Null and empty texts have no own licence but can inherit one; a null path has no directory. Ties go
to the template that comes first, and between licence files of one directory to the more similar,
then the lesser path. Repeated rows are scanned once each, long texts whole. Other columns, whatever
their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.cluster import bounded, written
from cellgrid.llm.license_texts import BODIES, HEADERS, TITLES

#: A header, and a run of lines, is a licence from these cosines on (bodies are templates of parts of long licences).
SIMILARITY, BODY_SIMILARITY = 0.75, 0.55
#: A run whose first lines have the title of a long licence is that licence from this cosine on.
TITLED_SIMILARITY = 0.4
#: A document is a licence file if this share of its letters is licence text.
FILE_SHARE = 0.5
#: Lines between two cues of one run (both are tried), lines around it, and its terms at least; lines from this length on are cut into sentences.
GAPS, AROUND, RUN_TERMS, LONG_LINE = (12, 48), 3, 40, 400

#: Directories with an inherited licence that are broadcast; beyond, and so many ways apart, they are joined.
HOMES_AT_ONCE, SALTS = 50_000, 32

_TERM = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


_HEADERS = [(name, Counter(terms(t))) for name, t in HEADERS]
_BODIES = [(name, Counter(terms(t))) for name, t in BODIES]
_VOCABULARY = sorted({t for _, c in (*_HEADERS, *_BODIES) for t in c})
_PLACE = {t: i for i, t in enumerate(_VOCABULARY)}
_ANY = re.compile(
    "(?i)licen[sc]|permission|redistribut|creative commons|rights reserved|public domain|subject to the terms|unencumbered|general public|copyright|warrant|liab|merchantab|as is\\b"
)
_HEADER_CUE = re.compile("(?i)licen[sc]|permission is|redistribution|creative commons|rights reserved|public domain|subject to the terms|unencumbered|general public")
_SENTENCE = re.compile(r"(?<=[.;:!?])\s+")


def weights(lines_with: np.ndarray, lines: int) -> np.ndarray:
    """Inverse frequencies of the vocabulary over all lines."""
    return np.log((1 + lines) / (1 + lines_with)) + 1


class Scanner:
    """Scores texts against the templates under given weights."""

    def __init__(self, idf: np.ndarray, lines: int):
        self.idf, self.lines = idf, lines
        self.rare = math.log(1 + lines) + 1  # a header's terms outside the templates weigh as ones seen in no other line
        self.usual = float(np.median(idf))  # in long texts, as the templates' own
        self.headers = [(name, *self._vector(c, self.rare)) for name, c in _HEADERS]
        self.bodies = [(name, *self._vector(c, self.usual)) for name, c in _BODIES]
        self.titles = [(name, *self._vector(Counter(terms(t)), self.rare)) for name, t in TITLES]
        self.seen: dict[str, tuple[float, str | None]] = {}

    def _vector(self, counts: Counter, outside: float) -> tuple[dict[str, float], float]:
        """Weights of a text's terms and their norm."""
        own = {t: (1 + math.log(k)) * (self.idf[_PLACE[t]] if t in _PLACE else outside) for t, k in counts.items()}
        return own, math.sqrt(sum(w * w for w in own.values()))

    def _closest(self, counts: Counter, templates: list, outside: float) -> tuple[float, str | None]:
        own, norm = self._vector(counts, outside)
        best, name = 0.0, None
        for licence, template, size in templates:
            dot = sum(w * own[t] for t, w in template.items() if t in own) if len(template) < len(own) else sum(w * template[t] for t, w in own.items() if t in template)
            if dot > best * norm * size:
                best, name = float(dot / (norm * size)), licence
        return best, name

    def header(self, text: str) -> tuple[float, str | None]:
        """(cosine, licence) of the header most like `text`."""
        found = self.seen.get(text)
        if found is None:
            found = self._closest(Counter(terms(text)), self.headers, self.rare)
            if len(text) <= LONG_LINE:  # so memory is bounded by the number of entries
                if len(self.seen) > 50_000:
                    self.seen.clear()
                self.seen[text] = found
        return found

    def body(self, lines: list[str]) -> tuple[float, str | None]:
        """(cosine, licence) of the licence text that a run of lines is most like; 0 if it is like none."""
        counts = Counter(terms("\n".join(lines)))
        if counts.total() < RUN_TERMS:
            return 0.0, None
        first = [line for line in lines if line.strip()][: 2 * AROUND]
        titled = max((self._closest(Counter(terms(" ".join(first[k : k + n]))), self.titles, self.rare) for k in range(len(first)) for n in (1, 2)), key=lambda f: f[0])
        if titled[0] >= SIMILARITY:
            found = self._closest(counts, [b for b in self.bodies if b[0] == titled[1]], self.usual)
            if found[0] >= TITLED_SIMILARITY:
                return found
        found = self._closest(counts, self.bodies, self.usual)
        return found if found[0] >= BODY_SIMILARITY else (0.0, None)

    def scan(self, text: str | None) -> tuple[str | None, float, bool]:
        """(licence, cosine, is a licence file) of a whole document."""
        if not text or not _ANY.search(text):
            return None, 0.0, False
        lines = [part for line in text.split("\n") for part in (_SENTENCE.split(line) if len(line) >= LONG_LINE else (line,))]
        covered = np.zeros(len(lines), bool)
        best = {"body": (0.0, None), "header": (0.0, None)}

        def take(kind: str, least: float, found: tuple[float, str | None], a: int, b: int) -> None:
            if found[0] >= least:
                covered[a:b] = True
                best[kind] = max(best[kind], found, key=lambda x: x[0])

        cued = [i for i, line in enumerate(lines) if _ANY.search(line)]
        for a, b in dict.fromkeys(run for gap in GAPS for run in _runs(cued, gap)):
            a, b = max(0, a - AROUND), min(len(lines), b + 1 + AROUND)
            take("body", TITLED_SIMILARITY, self.body(lines[a:b]), a, b)
        for i in cued:  # a header may be broken into up to three lines
            if _HEADER_CUE.search(lines[i]):
                for a, b in ((i, i + 1), (i - 1, i + 1), (i, i + 2), (i - 1, i + 2)):
                    if a >= 0 and b <= len(lines):
                        take("header", SIMILARITY, self.header(" ".join(lines[a:b])), a, b)
        score, name = best["body"] if best["body"][1] else best["header"]
        letters = sum(len(line) for line, hit in zip(lines, covered.tolist(), strict=True) if hit)
        return name, score, name is not None and letters >= FILE_SHARE * sum(map(len, lines))


def _runs(cued: list[int], gap: int) -> list[tuple[int, int]]:
    """First and last of the lines `cued` that lie within `gap` lines of each other."""
    out: list[tuple[int, int]] = []
    for i in cued:
        out[-1:] = [(out[-1][0], i)] if out and i - out[-1][1] <= gap else [*out[-1:], (i, i)]
    return out


def term_weights(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse line frequencies over the whole corpus; the driver gets one count a template term and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, lines, wanted = Counter(), 0, frozenset(_VOCABULARY)
        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").lower().split("\n"):
                    lines += 1
                    if met := {w.strip(".,;:()") for w in line.split()} & wanted:
                        found.update(met)
        found[""] = lines
        names = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([found[t] for t in names], pa.int64())], names=["term", "k"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term string, k long")
    total = {r.term: r.k for r in counted.groupBy("term").agg(F.sum("k").alias("k")).collect()}
    lines = total.pop("", 0)
    return weights(np.array([total.get(t, 0) for t in _VOCABULARY], float), lines), lines


def scan(files: DataFrame) -> DataFrame:
    """`files` (doc_id, path, text) -> own licence, and the one that holds by inheritance.

    Result: doc_id, path, own_license, score, is_license_file, license, license_dir (null unless inherited).
    """
    idf, lines = term_weights(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(idf, lines)
        for batch in batches:
            names, scores, whole = zip(*(scanner.scan(t.as_py()) for t in batch.column(2)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(whole, pa.bool_())],
                names=["doc_id", "path", "own_license", "score", "is_license_file"],
            )

    source = bounded(files).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    found = source.mapInArrow(run, "doc_id long, path string, own_license string, score double, is_license_file boolean")
    return inherit(written(found, "licenses"))


def parent(path):
    """The directory of a path; the root's is null."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path != "", F.lit(""))


def inherit(found: DataFrame) -> DataFrame:
    """Adds license and license_dir: a document's own, else that of its nearest ancestor directory with a licence file."""
    of_dirs = (
        found.filter("is_license_file and path is not null")
        .groupBy(parent(F.col("path")).alias("dir"))
        .agg(F.min(F.struct((-F.col("score")).alias("score"), "path", "own_license")).alias("top"))
        .select("dir", F.col("top.own_license").alias("dir_license"))
    )
    # each directory that holds documents, joined by path with every one of its ancestors
    homes = found.filter("own_license is null and path is not null").select(parent(F.col("path")).alias("home")).distinct()
    parts = F.split("home", "/")
    above = homes.select(
        "home",
        F.posexplode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))).alias("depth", "dir"),
    ).distinct()
    nearest = above.join(of_dirs, "dir").groupBy("home").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("near"))
    nearest = written(nearest, "license-homes")
    rows = found.withColumn("home", F.when(F.col("own_license").isNull(), parent(F.col("path"))))
    if nearest.limit(HOMES_AT_ONCE + 1).count() <= HOMES_AT_ONCE:
        joined = rows.join(F.broadcast(nearest), "home", "left")
    else:  # one directory may hold very many documents: its rows are dealt to SALTS tasks
        salts = nearest.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salts, ["home", "salt"], "left")
    return joined.select(
        "doc_id",
        "path",
        "own_license",
        "score",
        "is_license_file",
        F.coalesce("own_license", "near.dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("near.dir")).alias("license_dir"),
    )
