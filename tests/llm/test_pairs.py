"""Near-duplicate operators, suffix dedup and exact search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import awkward, components, empty
from shelfspark.llm import components as cc
from shelfspark.llm import filters, jaccard, lines, neardup, shingles, suffixes, topk


def test_connected_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in cc.connected_components(df).collect()}
    want = components(200, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert cc.connected_components(df.where("false")).count() == 0


def test_filters_keep_every_member(spark):
    values = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    df = spark.createDataFrame([(int(x),) for x in values[:2500]], "h long")
    table = filters.bit_filter(df, 20)
    assert filters.in_filter(table, values[:2500].view("uint64")).all()
    assert filters.in_filter(table, values[2500:].view("uint64")).mean() < 0.05
    everything = spark.createDataFrame([(int(x),) for x in values], "h long")
    kept = {r.h for r in everything.where(filters.row_filter(df, "h")).collect()}
    assert set(values[:2500].tolist()) <= kept and len(kept) < 2600


# -- embeddings -----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, v string, rep long"


def _vectors(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for group in range(30):
        center = rng.standard_normal(24)
        for _ in range(1 + group % 6):
            x = center + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.16, 0.3])
            rows.append((at, x.astype("float32").tolist(), group % 3, "v", 1))
            at += 1
    nan = float("nan")
    rows += [(at, None, 1, "v", 1), (at + 1, [0.0] * 24, 1, "v", 1), (at + 2, [nan] * 24, 1, "v", 1), (at + 3, [], 1, "v", 1),
             (at + 4, rows[0][1], None, "v", 1), (at + 5, [1.0, 2.0], 1, "v", 1), (at + 6, [1.0, 2.0], 1, "v", 1),
             (at + 7, [None] + [1.0] * 23, 1, "v", 1), (at + 8, [float("inf")] * 24, 1, "v", 1)]
    return rows, spark.createDataFrame(rows, VECTORS)


def test_near_vectors_against_all_pairs(spark):
    rows, df = _vectors(spark)
    x = {i: np.array(e, "float64") for i, e, label, *_ in rows if e and label is not None and None not in e}
    x = {i: e / np.linalg.norm(e) for i, e in x.items() if np.isfinite(e).all() and e.any()}
    labels = {i: label for i, _, label, *_ in rows}
    links = [(a, b) for a, b in combinations(x, 2) if labels[a] == labels[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.98]
    near = [(a, b) for a, b in links if x[a] @ x[b] < 0.999]
    assert len(near) > 5
    want = components(len(rows), links)
    n = Counter(i for pair in links for i in pair)
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], want[i], want[i] == i) for i in range(len(rows))}
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_blocks_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(4)
    center = rng.standard_normal(16)
    rows = [(i, (center + rng.standard_normal(16) * 0.01).tolist(), 1) for i in range(60)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def test_window_is_calibrated():
    m = 9
    w = neardup.half_width(m, 0.98)
    rng = np.random.default_rng(5)
    misses = (np.abs(rng.standard_normal((20_000, m)) * math.sqrt(0.04)) > w).sum(axis=1)
    assert (misses < neardup.GROUPS).mean() > neardup.RECALL - 0.005


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_against_all_products(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((150, 8)) * rng.choice([0.2, 1, 4], (150, 1)) * scale
    x[100:110] = x[5]  # ties
    rows = [(i, x[i].tolist(), 1) for i in range(150)] + [(150, None, 1), (160, [float("nan")] * 8, 1), (170, [1.0, 2.0], 1), (180, [], 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int")
    whole = np.floor(64 * x).astype("int64")
    want = set()
    for q in range(0, 150, 20):
        s = [sum(a * b for a, b in zip(whole[q].tolist(), whole[i].tolist())) for i in range(150)]
        order = sorted((i for i in range(150) if i != q), key=lambda i: (-s[i], i))[:5]
        want |= {(q, k + 1, i, s[i]) for k, i in enumerate(order)}
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()}
    assert got == want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 8))
    rows = [(i, x[i].tolist()) for i in range(60)]
    whole = np.floor(64 * x).astype("int64")
    want, best = set(), {}
    for q in (0, 20, 40):
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-int(whole[q] @ whole[i]), i))[:5]
        best[q] = order[0]
        want |= {(q, k + 1, i, int(whole[q] @ whole[i])) for k, i in enumerate(order)}
    rows += [rows[i] for i in best.values()] * 12
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()]
    assert sorted(got) == sorted(want)


# -- texts ----------------------------------------------------------------------

def _near_texts(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 4, 6, 9, 14, 40, 120]))]
        for _ in range(1 + g % 5):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words.append(rng.choice(vocabulary))
            out.append(" ".join(words))
    return out


def _set(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i:i + k]) for i in range(len(w) - k + 1)])


def test_shingle_sets_have_the_sizes_of_word_sets():
    texts = ["", None, "a", "A b", "a b c d a b c d a", "Ünï Ä b\x0bc\x0cd e", "x " * 3000, "b a"]
    sets = [s for part in shingles.shingle_sets(texts, 4) for s in part]
    assert [len(s) for s in sets] == [len(_set(t, 4)) for t in texts]
    assert sets[2].tolist() != sets[3].tolist() != sets[7].tolist()


@pytest.mark.parametrize("words,num", [(4, 85), (2, 80)])
def test_jaccard_against_all_pairs(spark, words, num):
    texts = _near_texts()
    docs = awkward(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    ids = sorted({i for i, _ in rows})
    sets = {i: _set(t, words) for i, t in rows}
    links = [(a, b) for a, b in combinations(ids, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    assert any(sets[a] != sets[b] for a, b in links)
    want = components(len(ids), links)
    got = jaccard.jaccard_components(docs, words, num, 100).collect()
    assert len(got) == docs.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(sets[i]), want[i]) for i in ids}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.jaccard_components(empty(spark), words, num, 100).count() == 0


def test_bitmaps_leave_out_only_sets_that_cannot_link(spark):
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype="uint64")) for n in (0, 1, 5, 60, 130, 900, 3000)]
    near = [np.unique(np.concatenate([s[: int(len(s) * 0.95)], rng.integers(0, 2**63, len(s) // 30, dtype="uint64")])) for s in sets]
    sets += [*near, *(np.unique(rng.integers(0, 2**63, n, dtype="uint64")) for n in (60, 130, 900, 3000))]
    maps = jaccard.bitmaps(sets)
    for (a, x), (b, y) in combinations(zip(sets, maps), 2):
        assert jaccard.least_difference(x, y) <= len(np.setxor1d(a, b))
    classes = spark.createDataFrame([(i, len(s), bytearray(m)) for i, (s, m) in enumerate(zip(sets, maps))], "set long, n int, bits binary")
    pairs = [(a, b) for a, b in combinations(range(len(sets)), 2) if min(len(sets[a]), len(sets[b])) >= 0.85 * max(len(sets[a]), len(sets[b]), 1)]
    got = {tuple(r) for r in jaccard._may_share(classes, spark.createDataFrame(pairs, "a long, b long"), 85, 100).collect()}
    linked = {(a, b) for a, b in pairs if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert linked <= got and len(linked) >= 4
    assert got == linked  # texts of unlike sets don't travel


def test_words_that_differ_in_a_pattern_stay_apart(spark):
    """Words of 1,024 letters that agree under every polynomial modulo 2^64."""
    signs = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[s ^ x] for s in signs) for x in (0, 1))
    docs = spark.createDataFrame([(1, f"{one} x y z"), (2, f"{other} x y z"), (3, f"{one} x y z")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_subsets_meet_exactly_when_small_sets_link():
    for boundary in (6, 14, 20):
        for a in range(1, boundary + 1):
            for b in range(a, boundary + 1):
                c = jaccard.shared_least(a, b, 85, 100)
                if c <= a:  # sizes that can link ask for the same subset size
                    assert c in jaccard.subset_sizes(a, boundary, 85, 100) and c in jaccard.subset_sizes(b, boundary, 85, 100)


def test_fuzzy_lines(spark):
    long = "the quick brown fox jumps over the lazy dog while many other animals look at it from the far side of the river and " * 3
    texts = [f"{long}one\nunique first line here\n\n---", f"{long.upper()}ONE!!\nsecond text", f"{long}one\nsecond  TEXT.\nlast", "a" * 200 + "\n" + "b"]
    docs = awkward(spark, texts)
    out = lines.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    # null ids come first, so the copy of text 0 with a null id keeps the lines
    assert got[0] == "\n---" and got[1] == "second text" and got[2] == "last" and got[3] == texts[3]
    assert got[len(texts)] is None and got[len(texts) + 1] == ""
    assert lines.deduplicated(empty(spark)).count() == 0


def test_near_lines_join_by_simhash_and_edits(spark):
    words = " ".join(f"word{i}" for i in range(120))
    near = words.replace("word60 ", "word60x ")
    docs = spark.createDataFrame([(1, words), (2, near), (3, " ".join(f"other{i}" for i in range(120)))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    assert got[1] == words and got[2] == "" and got[3].startswith("other0")


def _brute_spans(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mark[i:i + length] = True
        out.append(mark)
    return out


@pytest.mark.parametrize("length", [400, 120])
def test_suffix_dedup_against_all_windows(spark, length):
    rng = random.Random(8)
    letters = "abcdefghij é"
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [piece(n) for n in (length - 1, length, length + 1, length + 40, 3 * length)]
    texts = [piece(200) + shared[i % 5] + piece(rng.randrange(300)) + shared[(i * 3) % 5] for i in range(12)] + ["ab" * length, "x" * (length + 5)]
    docs = awkward(spark, texts)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = []
    for (i, t), mark in zip(rows, _brute_spans([t for _, t in rows], length)):
        edge = np.diff(mark.astype("int8"), prepend=0)
        want.append((i, len(t), int(mark.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(t, "uint8")[~mark].tobytes()).hexdigest()))
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
           for r in suffixes.cut_repeats(docs, length).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffixes.cut_repeats(empty(spark), length).count() == 0


def test_open_places_of_a_batch_against_each_text():
    rng = random.Random(12)
    length, piece = 400, lambda n: bytes(rng.choice(b"abcdef") for _ in range(n))
    shared = piece(900)
    texts = [b"", piece(399), shared[:400], piece(300) + shared, b"", shared + piece(200), piece(1000), shared[200:] + b"x", b""]
    hasher = suffixes.Hasher(texts)
    hashes, n = np.unique(hasher.at(hasher.sample(length)[0], length - suffixes.COVER + 1), return_counts=True)
    table = np.zeros(1 << 17, "uint8")
    for h in hashes[n > 1]:
        for odd in filters.PROBES:
            at = ((int(h) >> 58) << 14) + int(filters._slot(np.array([h]), odd, 20)[0])
            table[at >> 3] |= 1 << (at & 7)
    repeated = filters.BitFilter(20, {})
    repeated._table = table
    got = set(suffixes.open_places(hasher, repeated, length).tolist())
    for i, t in enumerate(texts):
        alone, start = suffixes.Hasher([t]), int(hasher.starts[i])
        own = suffixes.open_places(alone, repeated, length)
        assert {start + int(p) for p in own} == {p for p in got if start <= p < start + len(t)}
        assert alone.at(own, length).tolist() == hasher.at(own + start, length).tolist()
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    want = {int(hasher.starts[k]) + i for k, t in enumerate(texts) for i in range(len(t) - length + 1) if seen[t[i:i + length]] > 1}
    assert want and want <= got


def test_planted_passages_are_told_by_what_is_removed(spark):
    rng = random.Random(13)
    passage = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(60))
    shared = [passage() for _ in range(10)]
    texts = [f"{passage()} {shared[i % 10]} {passage()}" for i in range(20)] + [passage() + passage() for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in suffixes.cut_repeats(docs).collect()}
    assert all((got[i] >= 479) == (i < 20) and (got[i] == 0) == (i >= 20) for i in range(40))


def test_filter_of_repeated_samples_grows_with_them():
    assert [suffixes.filter_bits(n) for n in (0, 1, 1_160_000, 2 << 20, 5_823_826, 12_000_000, 10**9)] == [27, 27, 27, 27, 29, 30, 30]


@pytest.mark.parametrize("most", [30, 12])
def test_false_hits_of_a_full_filter_open_no_suffixes(spark, monkeypatch, most):
    """By a filter that grows, or by a join of its hits where it must not grow."""
    rng = random.Random(17)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    # 200 repeats of 395 bytes are repeated samples without a string of 400, one of 450 has some
    short, long = [text(395) for _ in range(200)], text(450)
    texts = [x for s in short for x in (f"{text(29)}1{s}2{text(29)}", f"{text(29)}3{s}4{text(29)}")] + [text(300) + long, long + text(300)] + [text(2000) for _ in range(100)]
    docs = awkward(spark, texts).where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r.doc_id: [tuple(s) for s in r.spans] for r in suffixes.cut_repeats(docs).collect()}
    assert {i for i, spans in want.items() if spans} == {400, 401}

    counts = []
    inner = suffixes.bit_filter
    monkeypatch.setattr(suffixes, "bit_filter", lambda h, bits: counts.append(h.count()) or inner(h, bits))
    monkeypatch.setattr(suffixes, "FILTER_BITS", 12)
    monkeypatch.setattr(suffixes, "MOST_BITS", most, raising=False)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffixes.cut_repeats(docs).collect()}
    assert got == want
    # samples repeated, and suffixes asked for: none of the 100 texts' 160,000, which false hits of so small a filter would open
    assert counts[0] >= 1500 and counts[1] < 30_000


def test_cover_has_every_difference():
    r = suffixes.RESIDUES
    assert {(a - b) % suffixes.COVER for a in r for b in r} == set(range(suffixes.COVER))


def test_dealt_hashes_find_all_that_stand_twice(spark):
    """Over batches, tasks and parts; a common hash is sent twice a batch at most."""
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 2**64 - 1, 300, "uint64", endpoint=True) for _ in range(6)]
    common = np.array([0, 1, 2**64 - 1, 2**55, 2**55 - 1], "uint64")
    lists += [np.concatenate([lists[0][:20], common]), np.repeat(lists[1][:3], 50), np.tile(common, 40), lists[2][:0]]
    dealt = [(p, h) for x in lists for p, h in zip(*suffixes.dealt(x).to_pydict().values())]
    assert sum(len(h) for _, h in dealt) == 8 * (6 * 300 + 25 + 6 + 10)
    got = [r.h for r in suffixes.repeated_hashes(spark.createDataFrame(dealt, "part int, hashes binary").repartition(5)).collect()]
    count = Counter(np.concatenate(lists).tolist())
    assert sorted(np.array(got).astype("int64").view("uint64").tolist()) == sorted(h for h, n in count.items() if n > 1)
    assert suffixes.repeated_hashes(spark.createDataFrame([], "part int, hashes binary")).count() == 0


def test_chosen_places_span_their_runs():
    rng, length = random.Random(4), 7
    rows, places = [], []
    for row in range(40):
        found = sorted(set().union(*(range(a, a + rng.choice((1, 2, 3, 4, 9, 30))) for a in (rng.randrange(90) for _ in range(3)))))
        rows += [row] * len(found)
        places += found
    rows, places = np.array(rows), np.array(places)
    which, gap = suffixes.chosen(rows, places, length)
    assert len(which) < len(places)
    for row in range(40):
        every, some = places[rows == row], places[which][rows[which] == row]
        assert (suffixes.covered(every, 200, length) == suffixes.covered(some, 200, length)).all()
        next_to = {x for x in some for step in (-1, 1) if x + step in every and x + step not in some}
        assert next_to == set(some[gap[rows[which] == row]])
    none = np.zeros(0, "int64")
    assert [len(x) for x in suffixes.chosen(none, none, length)] == [0, 0]


def test_false_hits_among_repeated_suffixes(spark, monkeypatch):
    """A full filter of dense repeats lets all open suffixes through: runs with a false end are looked at whole."""
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = [text(n) for n in (400, 401, 430, 900, 1300)]
    docs = awkward(spark, [text(500) + shared[i % 5] + text(200) + shared[(i + 1) % 5][:450] + text(30) for i in range(10)])
    spans = lambda: sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in suffixes.cut_repeats(docs).collect()), key=str)
    want, asked, inner = spans(), [], suffixes.row_filter
    sizes = iter((27, 27, 6))  # of the filters, the last one of the dense repeats
    inner_bits = suffixes.bit_filter
    monkeypatch.setattr(suffixes, "row_filter", lambda rows, c: asked.append(rows.count()) or inner(rows, c))
    assert spans() == want
    few = len(asked)
    monkeypatch.setattr(suffixes, "THIN", 1 << 40)  # no suffix is compared in the first step
    monkeypatch.setattr(suffixes, "bit_filter", lambda h, bits: inner_bits(h, 12 if next(sizes) == 6 else bits))
    assert spans() == want
    assert len(asked) == 2 * few + 1 and asked[-2] >= 5
