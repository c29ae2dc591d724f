"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import os
import random
import sys
import time
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellgrid.llm import bytebpe, fingerprints, licenses, mainhtml, neardup, neighbours, nngraph, packing, repeats, sharding, simhash, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(n))


LONG = prose(1, 20_000)
ROWS = [(1, None), (2, ""), (3, "   \n\t "), (4, "short"), (5, prose(2, 80)), (6, prose(2, 80)), (7, LONG), (7, prose(3, 60)), (None, prose(2, 80)), (8, prose(4, 30) + LONG[500:1500]), (8, prose(4, 30) + LONG[500:1500])]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, and columns named as the operators' own."""
    full = [(i, t, "x", "y", 1, "z", 2.0, 0) for i, t in ROWS]
    return spark.createDataFrame(full, "doc_id long, text string, row string, spans string, n int, whole string, score double, n_chars long").repartition(3)


def brute_repeats(rows):
    strings = Counter(b[i : i + 200] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 199))
    out = []
    for doc_id, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if strings[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append((doc_id, len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, docs):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in repeats.report(docs).collect()), key=repr)
    assert got == brute_repeats(ROWS)
    left = repeats.remove(docs)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    kept = left.collect()
    assert len(kept) == len(ROWS) and sum(r.text is None for r in kept) == 1
    assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)
    assert repeats.report(docs.limit(0)).count() == 0


def test_repeats_inside_one_text_and_cut_characters(spark):
    rows = [(1, "ab" * 300), (2, "é" * 150 + prose(5, 50)), (3, "x" + "é" * 150 + prose(6, 50)), (4, "line of text, again and again. " * 12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in repeats.report(frame).collect()), key=repr) == brute_repeats(rows)
    assert repeats.remove(frame).filter("doc_id = 1").first().text == ""


def test_split_groups_meet_by_digest(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_RUNS", 2)
    shared = prose(9, 60)
    rows = [(i, prose(100 + i, 20) + shared[: 300 + 7 * i] + prose(200 + i, 20)) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in repeats.report(frame).collect()), key=repr) == brute_repeats(rows)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
@settings(max_examples=150, deadline=None)
def test_suffix_array(symbols):
    array, common = repeats.suffix_array(np.array(symbols, np.int16))
    want = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    assert array.tolist() == want
    for k in range(1, len(want)):
        a, b = symbols[want[k - 1] :], symbols[want[k] :]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[k] == same


def test_shards_merge_a_group_over_several_arrays():
    rng = random.Random(4)
    pool = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(4)]
    texts = [b"".join(rng.choice(pool) for _ in range(3)) for _ in range(20)]
    length = 40
    strings = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for size in (1, 200, 10_000):
        shards = repeats.Shards(length, size)
        out = [x for i, t in enumerate(texts) for x in shards.add("g", i, t, len(t) - length + 1, False)] + list(shards.finish())
        assert sorted(i for i, _, _ in out) == list(range(20))
        for _, text, found in out:
            assert found.tolist() == [strings[text[i : i + length]] > 1 for i in range(len(found))]


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[3].fingerprint == "0" * 16 and by_id[3].component_id == 1
    assert by_id[6].component_id == 5
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_postings_tally_shared_bytes():
    """Every pair within three bits has a posting in common, and only pairs of five shared bytes are verified."""
    masks = [m & (2**64 - 1) for m in simhash._posting_masks(3)]
    rng = np.random.default_rng(2)
    assert len(masks) == 14 and all(m.bit_count() == 32 for m in masks)
    for bytes_ in itertools.combinations(range(8), 3):
        apart = sum(1 << (8 * b + int(rng.integers(8))) for b in bytes_)
        assert sum(apart & m == 0 for m in masks) == 1
    x = rng.integers(0, 2**63, 500, dtype=np.uint64)
    y = x ^ np.array([sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 6)))) for _ in x], np.uint64)
    tally = [sum(a >> s & 255 == b >> s & 255 for s in range(0, 64, 8)) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    want = [t >= 5 and (a ^ b).bit_count() <= 3 for t, a, b in zip(tally, x.tolist(), y.tolist(), strict=True)]
    assert simhash.linked(x, y, 3).tolist() == want and 0 < sum(want) < 500


def test_forest_is_the_same_by_lookup(monkeypatch):
    rng = np.random.default_rng(1)
    base = np.uint64(0xABCD) << np.uint64(24)
    fps = np.unique(base | rng.integers(0, 1 << 13, 1500).astype(np.uint64))
    free = (1 << 13) - 1
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert len(fps) > 1024 and simhash.forest(fps, 2, free).tolist() == label.tolist()


def test_near_copies(spark, docs):
    base = prose(20, 200).split()
    close, far = base.copy(), base.copy()
    close[100] = "changed"
    for i in range(0, 200, 8):
        far[i] = "other"
    rows = [(10, " ".join(base)), (11, " ".join(close)), (12, " ".join(far)), (13, None), (14, ""), (15, prose(21, 200))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.keep_first(frame).collect()) == [10, 12, 13, 15]
    kept = neardup.keep_first(docs)
    assert kept.dtypes == docs.dtypes and kept.filter("doc_id = 7").count() == 2
    assert neardup.keep_first(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies_gives_few_links(spark):
    base = prose(30, 150).split()
    rows = [(i, " ".join([*base[:75], f"w{i}", *base[76:]])) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    groups = neardup.groups(frame).collect()
    assert {r.group_id for r in groups} == {0}
    sigs = neardup.signatures(frame).withColumnRenamed("doc_id", "rep")
    assert neardup.links(sigs).count() < 2 * neardup.KEYS * 400


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    rows = [(i, [float(v) for v in x[i % 100 if i < 300 else i]]) for i in range(400)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0, None] + [0.0] * 6), (1080, [1.0]), (40, [9.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.nearest(frame).collect()
    assert {r.query_id for r in got} == set(range(0, 400, 20))
    assert max(r.vec_id for r in got) < 1000 and all(r.query_id != r.vec_id for r in got)
    assert Counter(r.query_id for r in got) == dict.fromkeys(range(0, 400, 20), 20)
    first = sorted((r for r in got if r.query_id == 60), key=lambda r: r["rank"])
    assert [(r["rank"], r.score) for r in first] == sorted(((r["rank"], r.score) for r in first), key=lambda p: p[0])
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert sorted(r.vec_id for r in neighbours.nearest(few).collect()) == [1, 2]
    assert neighbours.nearest(frame.limit(0)).count() == 0


def test_few_vectors_over_many_partitions_are_searched_exactly(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(45, 6))
    odd = [(-20, x[3].tolist(), "q", 1), (-20, (x[3] + 9).tolist(), "q", 1), (None, x[4].tolist(), "q", 1)]
    frame = spark.createDataFrame([(i, x[i // 2].tolist(), "q", 1) for i in range(90)] + odd, "vec_id long, embedding array<double>, node string, rank int")
    held = {i: x[i // 2] for i in range(90)} | {-20: min((x[3].tolist(), (x[3] + 9).tolist()))}
    conf = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = neighbours.nearest(frame.filter("vec_id is null or vec_id < 30")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    held = {i: np.array(v) for i, v in held.items() if i < 30}
    for q in (-20, 0, 20):
        want = sorted(((-float(np.dot(held[q], v)), i) for i, v in held.items() if i != q))[:20]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert np.allclose([-s for s, _ in want], [s for _, _, s in mine])
        assert {i for s, i in want if s < want[-1][0] - 1e-9} <= {i for _, i, _ in mine}
    assert {r.query_id for r in got} == {-20, 0, 20}


def brute_nearest(x, ids, q, top=20):
    s = x[q] @ x.T
    s[q] = -np.inf
    return [ids[k] for k in np.argsort(-s, kind="stable")[:top]]


def test_neighbours_of_many_shards(spark, monkeypatch):
    """Answers come from every shard, and a copy that lies anywhere is found."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 700)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24))
    x[1500:1600] = x[40] + 1e-3 * rng.normal(size=(100, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(got) == set(range(0, 3000, 20)) and all(len(found) == 20 for found in got.values())
    assert np.mean([len(set(brute_nearest(x, range(3000), q)) & set(found)) / 20 for q, found in got.items()]) > 0.97
    assert all(abs(s - float(x[q] @ x[w])) < 1e-9 for q, found in got.items() for w, s in found.items())


def test_neighbours_takes_few_jobs(spark):
    """A vector is sent to its shard and not to its links in every round."""
    x = np.random.default_rng(10).normal(size=(2500, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    tag = "neighbours-jobs"
    spark.sparkContext.setJobGroup(tag, tag)
    try:
        assert neighbours.nearest(frame).count() == 125 * 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag)) <= 30


@pytest.mark.parametrize(("rows", "factor"), [(1, 1.0), (2, 1.0), (30, 1e200), (600, 1e-200), (5000, 1.0)])
def test_graph_and_walk(rows, factor):
    x = np.random.default_rng(rows).normal(size=(rows, 12)) * factor
    x[0] *= 1e-9  # rows of unlike size are compared in double precision
    y = nngraph.scaled(x)
    walk = nngraph.Walk(nngraph.Graph(y).descend())
    asked = np.arange(0, rows, 20)
    q = x[asked] / np.abs(x[asked]).max(axis=1, keepdims=True)
    found = walk.nearest(q.astype(y.dtype), np.where(asked % 40 == 0, asked, -1))
    want = np.argsort(-(q @ (x / np.abs(x).max()).T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / len(b) for a, b in zip(found, want, strict=True)]) > 0.98
    assert all(len(set(a[a >= 0])) == (a >= 0).sum() for a in found)


def test_toxicity(spark, docs):
    rng = random.Random(8)
    make = lambda bad: " ".join([*rng.sample(WORDS, 12), *(["grobkak" + rng.choice("abcdefgh")] if bad else []), *rng.sample(WORDS, 12)])
    rows = [(i, make(i % 4 == 0)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(9999, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    held = [r for r in toxicity.score(frame, model).collect() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    assert model.score("alpha beta grobkakz gamma") >= 0.7 > model.score(None) == model.score("")
    assert len(toxicity.score(docs, model).collect()) == len(ROWS)
    kept = toxicity.keep_clean(docs, model)
    assert kept.dtypes == docs.dtypes and kept.count() == len(ROWS)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r.predicted for r in toxicity.score(frame, toxicity.fit(frame, labels.limit(0))).collect()} == {0}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a &amp; b&nbsp;c &#233;<p>d\n  e</p>", "a & b c é\nd e"),
        ("<nav>Menu one</nav><article><h1>T</h1><p>One.<br>two</p><aside>side</aside><ul><li>x<li>y</ul></article><footer>f</footer>", "T\nOne. two\nx\ny"),
        ("<body><div id=sidebar>s</div><div class='post'><p>Long, long text. More of it, here.</p></div><div class=comments><p>me, too. yes.</p></div><script>var a='<p>no</p>'</script></body>", "Long, long text. More of it, here."),
        ("<article><p>cut off <b>he", "cut off he"), ("<article><p>a<!-- c --><![CDATA[d]]></p></article><p>out", "ad"), ("<head><title>t</title></head><article><form>f<input></form><header>h</header><p>b</p></article>", "h\nb"),
    ],
)
def test_main_text(page, want):
    assert mainhtml.main_text(page) == want


SENTENCE = "This is a long sentence, with words and commas, about something. "


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # a teaser in an article element beside the text
        ("<article>nav nav nav</article><div>" + f"<p>{SENTENCE}</p>" * 50 + "</div>", "\n".join([SENTENCE.strip()] * 50)),
        # a container without an article: its short paths follow, the sidebar's do not
        (f"<div class=story><h2>Head</h2><p>{SENTENCE * 4}</p><blockquote>Quoted words</blockquote><ul><li>one<li>two</ul></div><div class=x><ul><li>Three<li>four</ul></div>", f"Head\n{(SENTENCE * 4).strip()}\nQuoted words\none\ntwo"),
        # a second, short article
        (f"<article><p>{SENTENCE * 20}</p></article><article><p>Short one.</p></article>", f"{(SENTENCE * 20).strip()}\nShort one."),
        # names that speak against everything decide nothing
        (f"<div class=with-sidebar><h1>T</h1><p>{SENTENCE * 9}</p></div><div class=sidebar>More, text. Here.</div>", f"T\n{(SENTENCE * 9).strip()}"),
        # reader comments and adverts in the article, however long
        (f"<article><p>{SENTENCE * 3}</p><div class=ad>{SENTENCE * 9}</div><section id=comments><p>{SENTENCE * 9}</p></section></article>", (SENTENCE * 3).strip()),
    ],
)
def test_main_text_is_told_by_ratios(page, want):
    assert mainhtml.main_text(page) == want


@pytest.mark.parametrize("make", ["<div>x", '<a "', "<a ", "<p>x", "<b><i>", "<!--", '<a b="', "<table><td>x", "</div>"])
def test_broken_pages_are_read_in_linear_time(make):
    began = time.monotonic()
    mainhtml.main_text(make * (1_000_000 // len(make)))
    assert time.monotonic() - began < 10


@given(st.lists(st.tuples(st.sampled_from(["one", "two", "three"]), st.sampled_from(["p", "h2", "li"]), st.integers(1, 30), st.integers(0, 4)), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_ratios_are_those_of_their_paths(blocks):
    """On plain pages of three containers, content by ratios computed from lists."""
    page = "".join(f"<div class={c}><{t}>{'w' * n}{'.' * k}</{t}></div>" for c, t, n, k in blocks)
    by_path, by_home = {}, {}
    for c, t, n, k in blocks:
        by_path.setdefault((c, t), []).append((n + k, k))
        by_home.setdefault(c, []).append((n + k, k))
    mean = lambda rows, at: sum(r[at] for r in rows) / len(rows)
    mixed = lambda p, at: mainhtml.OWN * mean(by_path[p], at) + (1 - mainhtml.OWN) * mean(by_home[p[0]], at)
    ratio = {p: mixed(p, 0) * (0.5 + mixed(p, 1)) for p in by_path}
    total = {p: sum(n for n, _ in rows) for p, rows in by_path.items()}
    bar = mainhtml.SHARE * ratio[max(by_path, key=lambda p: total[p] * ratio[p])]
    hits = {p for p in by_path if ratio[p] >= bar}
    whole = {c for c in by_home if sum(total[p] for p in hits if p[0] == c) >= mainhtml.CONTAINER * sum(n for n, _ in by_home[c])}
    near = any(abs(r - bar) < 1e-9 * bar for r in ratio.values())  # sums in another order
    want = ["w" * n + "." * k for c, t, n, k in blocks if (c, t) in hits or c in whole]
    assert near or mainhtml.main_text(page) == "\n".join(want)


def test_main_text_of_odd_tables(spark):
    frame = spark.createDataFrame([(1, None, None, "k"), (1, "u", "<p>x", "k"), (None, "u", "<p>x", "k")], "page_id long, url string, html string, text string")
    assert sorted(((r.page_id, r.text, r.n_chars) for r in mainhtml.extract(frame).collect()), key=repr) == sorted([(1, "", 0), (1, "x", 1), (None, "x", 1)], key=repr)
    assert mainhtml.extract(frame.limit(0)).count() == 0


def test_fingerprints(spark, docs):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(ROWS)
    rows = [(1, "ＡＢ  c"), (2, "ab\tC "), (3, "abd"), (4, "é"), (5, "é")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    by_id = {r.doc_id: r for r in fingerprints.fingerprints(frame).collect()}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[1].near_next == 1.0 and by_id[2].near_next == 0.0
    assert by_id[4].near_next == 1.0 and by_id[5].near_next == 0.0
    assert {(r.doc_id, r.group_id) for r in fingerprints.exact_groups(frame).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)}
    folds = spark.createDataFrame([(6, "Straße ΣΑΣ"), (7, "STRASSE σας"), (8, "İ"), (None, "strasse  σασ")], "doc_id long, text string")
    assert {(r.doc_id, r.group_id) for r in fingerprints.exact_groups(folds).collect()} == {(6, 6), (7, 6), (8, 8), (None, 6)}
    grouped = fingerprints.exact_groups(docs).collect()
    assert len(grouped) == len(ROWS) and {r.group_id for r in grouped if r.doc_id in (1, 2, 3)} == {1}
    assert fingerprints.exact_groups(docs.limit(0)).count() == 0
    one = fingerprints.fingerprints(frame.filter("doc_id = 3")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0


def test_equal_digests_of_different_bytes_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.lpad(F.length(canon).cast("string"), 32, "0"))
    frame = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "CD "), (4, "ab"), (5, "xyz")], "doc_id long, text string")
    assert {(r.doc_id, r.group_id) for r in fingerprints.exact_groups(frame).collect()} == {(1, 1), (2, 2), (3, 2), (4, 1), (5, 5)}


def test_packing(spark, docs):
    rows = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in rows if r.start == 0 and r.doc_id == 1) == 1
    assert {r.doc_id for r in rows} == {i for i, _ in ROWS}
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packed_groups_cost_about_the_same():
    packer = packing.Packer(0)
    rng = np.random.default_rng(2)
    for i in range(600):
        packer.add(i, np.zeros(int(rng.integers(1, 5000)), "<u4"))
    packer.finish()
    cost, tokens = Counter(), Counter()
    for r in packer.rows:
        if r[7] == packing.WINDOW:
            cost[r[8]] += r[2] ** 2
            tokens[r[5]] += r[2]
    full = sorted(cost.values())[1:]
    assert set(tokens.values()) == {packing.WINDOW} and max(full) <= 2.5 * min(full)


_RANKS = bytebpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
_OURS = bytebpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
_PLAIN = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=_RANKS, special_tokens={})


@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab c'st\n\t \x1c\x85\xa01é日🤗", max_size=80)))
@settings(max_examples=400, deadline=None)
def test_bytes_are_merged_as_by_rank(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = _OURS.encode(text)
    assert ids.tolist() == _PLAIN.encode_ordinary(text)
    assert _OURS.decode(ids) == text.encode()


def test_byte_bpe_of_odd_rows(spark, docs):
    got = bytebpe.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}


def test_other_vocabularies_are_encoded_by_the_library():
    path = P.path("byte_bpe_50k.json")
    ids = packing.WordIds(path)
    assert not ids.chunked and packing.WordIds(P.path("word_bpe_49k.json")).chunked
    assert ids.encode("Two  words,\nthree").tolist() == ids.tokenizer.encode("Two  words,\nthree", add_special_tokens=False).ids


def test_caches_do_not_hold_long_chunks():
    ids = packing.WordIds(P.path("word_bpe_49k.json"))
    ids.encode("x" * 100_000 + " short")
    assert max(map(len, ids)) <= packing.CACHED_BYTES and max(map(len, ids.pretokens)) <= packing.CACHED_BYTES
    _OURS.encode("z" * 100_000 + " short")
    assert max(map(len, _OURS.chunks)) <= bytebpe.CACHED_CHARS and max(map(len, _OURS.pieces)) <= bytebpe.CACHED_CHARS


_WORD_IDS = packing.WordIds(P.path("word_bpe_49k.json"), 50)


@given(st.one_of(st.text(max_size=40), st.text(alphabet="abAB éÉÀß½²ª́'st\n<|>.9Σİ", max_size=60)))
@settings(max_examples=300, deadline=None)
def test_cached_words_have_the_tokenizers_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    assert _WORD_IDS.encode(text).tolist() == _WORD_IDS.tokenizer.encode(text, add_special_tokens=False).ids


def test_new_words_cost_few_calls():
    ids, calls = packing.WordIds(P.path("word_bpe_49k.json")), Counter()
    words = [f"{a}{b}{c}." for a in ("Ba", "di", "ko", "lu") for b in ("nor", "tés", "gim") for c in map("".join, itertools.product("aeiou", "rstlm", "aeiou"))]
    sys.setprofile(lambda _, event, __: calls.update([event]))
    try:
        got = ids.encode(" ".join(words))
    finally:
        sys.setprofile(None)
    assert got.tolist() == ids.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    assert calls["call"] + calls["c_call"] < 12 * len(words)


def test_texts_taken_together_have_the_tokenizers_ids(monkeypatch):
    texts = [None, "", " \t", "  Don't  stop\r\n", "na\u00efve caf\u00e9\u00b2 x\u00ad1/2", "\u65e5\u672c it's", "a\x1cb \x85", "<|endoftext|> </w>", "e\u0301 \u0301", "x" * 250 + " y", "''s 'S '", None, "stop Don't na\u00efve"] * 3
    ids = packing.WordIds(P.path("word_bpe_49k.json"), 9)
    want = [ids.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        assert [x.tolist() for x in ids.encode_all(pa.array(texts, kind))] == want
        assert [x.tolist() for x in ids.encode_all(pa.array(texts, kind)[5:20])] == want[5:20]
    assert ids.encode_all(pa.array([], pa.string())) == [] and len(ids) <= 9
    monkeypatch.setattr(ids, "last", np.zeros_like(ids.last))  # as if no token told the end of a word
    ids.clear()
    assert [x.tolist() for x in ids.encode_all(pa.array(texts))] == want


def test_groups_of_texts_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(packing, "TEXT_BYTES", 1000)
    texts = ["x" * n if n % 7 else None for n in (*range(0, 400, 9), 5000, 3, 2000, 2000, *[0] * 50)]
    rows = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    batches = [rows.slice(0, 0), *[rows.slice(at, 11) for at in range(0, len(texts), 11)]]
    groups = [g.to_pydict() for g in packing._groups(iter(batches))]
    assert [t for g in groups for t in g["text"]] == texts and [i for g in groups for i in g["doc_id"]] == list(range(len(texts)))
    assert all(len(g["text"]) == 1 or sum(len(t or "") + packing.ROW_BYTES for t in g["text"]) <= 1000 for g in groups)
    assert len(groups) < len(texts) / 2 and list(packing._groups(iter([]))) == []


def test_a_worker_keeps_its_words():
    assert packing.word_ids(P.path("word_bpe_49k.json")) is packing.word_ids(P.path("word_bpe_49k.json"))


def test_licenses(spark):
    rows = [
        (1, "a/b/x.txt", prose(9, 20) + "\nLicensed under the Apache License, Version 2.0."), (2, "a/LICENSE", "Released under the MIT License."), (3, "a/b/c/y.txt", "plain text"), (4, "z/y.txt", None),
        (5, None, ""), (6, "a/b/z.txt", "the licensed plumber called under the bridge"), (7, "a/b/z.txt", "This work is licensed under the GNU General Public License,\nversion 3. " + prose(1, 40)), (7, "q.txt", "nothing"),
    ]
    got = {(r.doc_id, r.path): (r.own_license, r.license, r.license_dir) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1, "a/b/x.txt"] == ("Apache-2.0", "Apache-2.0", None)
    assert got[3, "a/b/c/y.txt"] == (None, "MIT", "a") and got[6, "a/b/z.txt"] == (None, "MIT", "a")
    assert got[4, "z/y.txt"] == got[5, None] == got[7, "q.txt"] == (None, None, None)
    assert got[7, "a/b/z.txt"][0] == "GPL-3.0"


def brute_license(texts):
    """Per text the header most like one of its lines by plain TF-IDF cosine, and the cosine."""
    split = licenses.terms
    lines = [line for t in texts for line in (t or "").split("\n")]
    with_term = Counter(t for line in lines for t in {w.strip(".,;:()") for w in line.lower().split()})
    weigh = lambda c, known: {t: (1 + np.log(k)) * (np.log((1 + len(lines)) / (1 + with_term[t] * (t in known))) + 1) for t, k in c.items()}
    templates = [(name, Counter(split(t))) for name, t in licenses.HEADERS]
    known = {t for _, text in (*licenses.HEADERS, *licenses.BODIES) for t in split(text)}
    cosine = lambda x, y: sum(w * y.get(t, 0) for t, w in x.items()) / np.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values()))
    out = []
    for t in texts:
        found = [(cosine(weigh(Counter(split(line)), known), weigh(c, known)), name) for line in (t or "").split("\n") if split(line) for name, c in templates]
        out.append(max(found, key=lambda f: f[0], default=(0.0, None)))
    return out


def test_license_scores_are_tfidf_cosines(spark):
    texts = [prose(300 + i, 12) + "\n" + header + "\n" + prose(400 + i, 12) for i, (_, header) in enumerate(licenses.HEADERS)] + [prose(5, 30), None]
    frame = spark.createDataFrame([(i, f"d/{i}", t, 1.0) for i, t in enumerate(texts)], "doc_id long, path string, text string, score double")
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    for i, (score, name) in enumerate(brute_license(texts)):
        assert got[i].own_license == (name if score >= licenses.SIMILARITY else None)
        assert got[i].own_license is None or got[i].score >= score - 1e-9  # joined lines may score higher


def test_license_files_and_their_directories(spark):
    body = {name: text for name, text in licenses.BODIES}
    wrapped = lambda t: "\n".join(t[i : i + 70] for i in range(0, len(t), 70))
    rows = [
        (1, "m/LICENSE", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrapped(body["MIT"])), (2, "b/COPYING", "Copyright (c) 1999 Some University\n" + body["BSD-3-Clause"]),
        (3, "m/a/x.py", "nothing"), (4, "b/y", None), (5, "m/a/own.c", "/*\n * " + wrapped(body["ISC"]).replace("\n", "\n * ") + "\n */\n" + prose(70, 400)), (6, "m/long", prose(71, 30_000)),
    ]
    places = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "BSD": "BSD-3-Clause", "MPL-2.0": "MPL-2.0", "LGPL-3": "LGPL-3.0"}
    there = [(k, v) for k, v in places.items() if os.path.isfile(f"/usr/share/common-licenses/{k}")]  # whole texts, where the system has them
    for at, (name, _) in enumerate(there):
        rows += [(100 + at, f"t{at}/LICENSE", open(f"/usr/share/common-licenses/{name}").read()), (200 + at, f"t{at}/src/z", prose(80 + at, 50))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [(got[i].own_license, got[i].is_license_file) for i in (1, 2, 5, 6)] == [("MIT", True), ("BSD-3-Clause", True), ("ISC", False), (None, False)]
    assert (got[3].license, got[3].license_dir) == ("MIT", "m") and (got[4].license, got[4].license_dir) == ("BSD-3-Clause", "b") and got[6].license == "MIT"
    for at, (_, name) in enumerate(there):
        assert (got[100 + at].own_license, got[100 + at].is_license_file, got[200 + at].license) == (name, True, name)


def test_licenses_of_odd_tables(spark, docs):
    odd = docs.withColumn("path", F.lit("a/b")).withColumn("home", F.lit("x")).withColumn("license", F.lit("y"))
    got = licenses.scan(odd)
    assert got.columns == ["doc_id", "path", "own_license", "score", "is_license_file", "license", "license_dir"] and got.count() == len(ROWS)
    assert licenses.scan(odd.limit(0)).count() == 0
    tied = [(i, f"d/{n}", "Released under the MIT License." if n < "c" else "Licensed under the Apache License, Version 2.0.") for i, n in enumerate("dbac")] + [(9, "d/e/f", "x")]
    frame = spark.createDataFrame(tied, "doc_id long, path string, text string")
    want = {r.doc_id: r for r in licenses.scan(frame).collect()}
    top = min((-r.score, r.path, r.own_license) for r in want.values() if r.is_license_file)
    assert (want[9].license, want[9].license_dir) == (top[2], "d")


def test_many_directories_are_joined_by_salt(spark, monkeypatch):
    monkeypatch.setattr(licenses, "HOMES_AT_ONCE", 1)
    rows = [(k, f"d{k % 3}/{k}", "Released under the MIT License." if k < 3 else "x") for k in range(60)] + [(99, None, "x")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert len(got) == 61 and sum(r.license == "MIT" for r in got) == 60


def test_shards_are_merged_and_versions_are_kept(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 20)
    for k in range(5):
        store.append(spark.range(100 * k, 100 * (k + 1)).withColumn("shard", F.lit("clash")).coalesce(1))
    assert store.version() == 5 and store.manifest().count() == 5
    assert store.compact() == 6 and store.manifest().count() == 1
    assert sorted(r.id for r in store.read().collect()) == list(range(500)) == sorted(r.id for r in store.read(5).collect())
    assert store.compact() == 6
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(store.manifest(), 5)
    assert store.version() == 6
    spark.range(3).withColumn("shard", F.lit("lost")).coalesce(1).write.parquet(f"file://{tmp_path}/store/shards/arrival-lost")  # never committed
    assert len(store.vacuum()) == 5 and store.read().count() == 500 and store.versions() == [6]
    assert len(store.vacuum(grace_seconds=0)) == 1 and store.read().count() == 500
    with pytest.raises(ValueError, match="columns"):
        store.append(spark.range(3))


def test_manifests_name_files_of_the_target_size_and_all_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 18)
    for k in range(6):
        store.append(docs.filter(f"doc_id % 6 = {k}").repartition(3), by="source")
    small = store.manifest().count()
    store.compact()
    now = store.manifest().collect()
    assert len(now) < small and sum(r.rows for r in now) == docs.count() and max(r.bytes for r in now) < 3 * (1 << 18)
    assert {r.tier for r in now} == {max(0, int(np.floor(np.log(r.bytes / sharding.SMALLEST_TIER) / np.log(4)))) for r in now}
    assert sorted(r.doc_id for r in store.read().collect()) == sorted(r.doc_id for r in docs.collect())


def test_empty_tables_and_clashing_columns_are_sharded(spark, docs, tmp_path):
    for at, by in enumerate((None, "text")):
        none = sharding.sharded(docs.limit(0), f"file://{tmp_path}/none{at}", by=by)
        assert none.count() == 0 and none.columns == [*docs.columns, "shard", "shard_bytes"]
    clash = docs.withColumnRenamed("n", "shard").withColumnRenamed("row", "_metadata")
    got = sharding.sharded(clash, f"file://{tmp_path}/clash")
    assert got.columns == [*clash.columns, "shard_", "shard_bytes"] and got.filter("shard = 1 and shard_ like '%.parquet'").count() == len(ROWS)


def test_rows_of_every_kind_are_sharded(spark, docs, tmp_path):
    got = sharding.sharded(docs.drop("n_chars"), f"file://{tmp_path}/s", by="text")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(ROWS, key=repr)


def brute_groups(frame):
    """id -> least id of its group, by the similarity of all pairs."""
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, neardup.SHINGLE).tolist()) for r in frame.collect()}
    ids = sorted(sets)
    label = {i: i for i in ids}
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both >= neardup.SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize(("edits", "rows_at_once"), [(4, 1024), (6, 1024), (6, 50)])
def test_copies_that_are_alike_only_by_their_original(spark, monkeypatch, edits, rows_at_once):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows_at_once)
    base = prose(40, 200).split()
    rng = random.Random(41)
    rows = [(200, " ".join(base))]
    for i in range(400):
        copy = base.copy()
        for _ in range(rng.randrange(1, edits + 1)):
            copy[rng.randrange(200)] = f"edit{rng.randrange(10**9)}"
        rows.append((i if i < 200 else i + 1, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.group_id for r in neardup.groups(frame).collect()}
    assert got == brute_groups(frame)
    assert max(Counter(got.values()).values()) > 250


def test_a_group_of_thousands_and_pairs_at_the_threshold(spark):
    """5,000 copies of one text, of one to four edits, and pairs that just reach the similarity: nine in ten pairs at least are joined."""
    base, rng, rows = prose(42, 120).split(), random.Random(43), []
    for i in range(5000):
        copy = base.copy()
        for _ in range(1 + i % 4):
            copy[rng.randrange(120)] = f"edit{rng.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    for i in range(200):  # 104 words, of which two far apart differ: 90 of 110 shingles
        one = prose(1000 + i, 104).split()
        two = one.copy()
        two[30], two[70] = "left", "right"
        rows += [(10_000 + i, " ".join(one)), (20_000 + i, " ".join(two))]
    got = {r.doc_id: r.group_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    light = [got[i] for i in range(5000) if i % 4 == 0]  # one edit each: 110 or more of 122 shingles shared with each other
    assert Counter(light).most_common(1)[0][1] >= 0.99 * len(light)
    assert sum(got[10_000 + i] == got[20_000 + i] for i in range(200)) >= 180
    assert all(got[10_000 + i] >= 10_000 for i in range(200))


@pytest.mark.parametrize("block", [2048, 16])
def test_a_postings_forest_joins_what_is_close(monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, (6, 2), dtype=np.uint64)
    sig = centres[rng.integers(0, 6, 120)]
    for row in sig:
        for bit in rng.integers(0, 128, 16):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    near = neardup._apart(sig, sig) <= neardup.DIFFERING
    label = np.arange(len(sig))
    for _ in range(len(sig)):
        label = np.where(near, label[None, :], len(sig)).min(axis=1)
    assert neardup.forest(sig).tolist() == label.tolist() and len(set(label.tolist())) > 1


def test_near_copies_are_told_by_sets(spark):
    """A list repeated twice or forty times: the same or almost the same set of shingles."""
    base, item = prose(50, 300), prose(51, 8)
    rows = [(1, f"{base} {item} {item}"), (2, f"{base} {' '.join([item] * 40)}"), (3, f"{base} {' '.join([item] * 40)} end")]
    sigs = {r.doc_id: r for r in neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    apart = lambda x, y: sum(((sigs[x][f"s{w}"] ^ sigs[y][f"s{w}"]) & (2**64 - 1)).bit_count() for w in range(neardup.WORDS))
    assert sigs[1].copy == sigs[2].copy and apart(1, 2) == 0
    assert sigs[2].copy != sigs[3].copy and apart(2, 3) < 0.1 * 64 * neardup.WORDS


def test_texts_under_equal_or_null_ids_stay(spark):
    one, two, near = prose(60, 80), prose(61, 80), prose(62, 80)
    rows = [(1, near), (7, one), (7, two), (7, near), (None, prose(63, 80)), (None, prose(64, 80)), (None, one), (9, two), (None, None), (8, "")]
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [r.text or "" for r in kept]
    assert sorted(texts) == sorted({t or "" for _, t in rows})
    assert {(r.doc_id, r.text) for r in kept} == {(1, near), (None, one), (7, two), (None, prose(63, 80)), (None, prose(64, 80)), (None, None)}
