"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is turned into a few shape features (case, marks, repetition, line
and word lengths). Every feature is cut into quantile bins; boosting cycles
over the features and adds to each one's lookup table a shallow tree over its
bins, then over the most useful pairs of features with small two-way tables.
A score is the sum of the looked-up values, added bin-wise for whole batches.

Defined cases: null text is read as empty, and empty texts get the value of
their bins; rows with null label or id aren't learnt from; with one class only
(or no labels) every score is that class's smoothed rate; repeated rows score
alike; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import labelled_sample, stored

MAX_LABELLED = 20_000
BINS = 48
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 250
PAIR_ROUNDS = 80
RATE = 0.1
LEAVES = 3  # of a tree over the bins of one feature
SMOOTH = 5.0

FEATURES = ["chars", "words", "word_length", "upper", "digits", "marks", "symbols", "exclaims", "bars", "spaces", "lines",
            "distinct", "top_word", "same_next", "line_repeats", "line_length", "longest_word", "entropy"]


def _classes() -> np.ndarray:
    """Class of the first 256 code points: 1 upper, 2 digit, 3 mark, 4 symbol, 5 exclamation, 6 bar, 7 space, 8 line end."""
    out = np.zeros(257, "int64")
    for c in range(256):
        ch = chr(c)
        out[c] = (5 if ch == "!" else 6 if ch == "|" else 8 if ch == "\n" else 7 if ch.isspace() else 1 if ch.isupper()
                  else 2 if ch.isdigit() else 3 if ch in ".,;:?'\"()-" else 0 if ch.isalnum() else 4)
    return out


_CLASS = _classes()


def features(text: str | None) -> list[float]:
    """The numbers that a score reads, of the whole text."""
    text = text or ""
    n = max(len(text), 1)
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), 256)
    seen = np.bincount(codes, minlength=257)
    kinds = np.bincount(_CLASS, weights=seen, minlength=9) / n
    share = seen[seen > 0] / n
    words = text.split()
    n_words = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    same = sum(map(str.__eq__, words, words[1:]))
    return [np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n_words, *kinds[1:9],
            len(counts) / n_words, max(counts.values(), default=0) / n_words, same / n_words,
            1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(text) / max(len(lines), 1)),
            max(map(len, words), default=0), float(-(share * np.log(share)).sum())]


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]  # of the bins, by feature
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(edges)), int)


def _edges(x: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.arange(1, n) / n)) for j in range(x.shape[1])]


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Best-first tree over ordered bins with sums of gradients and curvatures:
    a value for every bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        cut = np.arange(a + 1, b)
        if not len(cut):
            return 0.0, -1
        lg, lh, rg, rh = cg[cut] - cg[a], ch[cut] - ch[a], cg[b] - cg[cut], ch[b] - ch[cut]
        gain = lg**2 / (lh + SMOOTH) + rg**2 / (rh + SMOOTH) - (cg[b] - cg[a])**2 / (ch[b] - ch[a] + SMOOTH)
        k = int(gain.argmax())
        return float(gain[k]), int(cut[k])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        (gain, cut), k = max((best(*p), i) for i, p in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + SMOOTH)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best cut of a two-way table into four cells: its values and the gain."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    found, gain = np.zeros_like(g), 0.0
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            cells = [(0, i, 0, j), (0, i, j, g.shape[1]), (i, g.shape[0], 0, j), (i, g.shape[0], j, g.shape[1])]
            sums = [tuple(c[b, d] - c[a, d] - c[b, e] + c[a, e] for c in (cg, ch)) for a, b, e, d in cells]
            new = sum(x * x / (y + SMOOTH) for x, y in sums)
            if new > gain + 1e-12:
                gain, found = new, np.zeros_like(g)
                for (a, b, e, d), (x, y) in zip(cells, sums):
                    found[a:b, e:d] = -x / (y + SMOOTH)
    return found, gain


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the logistic loss on features ``x`` and labels ``y``."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    edges = _edges(x, BINS) if len(x) else [np.zeros(0)] * len(FEATURES)
    pair_edges = _edges(x, PAIR_BINS) if len(x) else edges
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(x) or y.min() == y.max():
        return Model(base, edges, tables, [], pair_edges, [])
    bins, score = _binned(x, edges), np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)), LEAVES)
            table += step
            score += step[bins[:, j]]
    coarse = _binned(x, pair_edges)
    width = [len(e) + 1 for e in pair_edges]

    def two_way(a: int, b: int) -> tuple[np.ndarray, float]:
        g, h = slopes()
        cell, shape = coarse[:, a] * width[b] + coarse[:, b], (width[a], width[b])
        return _quadrants(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape))

    pairs = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -two_way(*p)[1])[:PAIRS]
    pair_tables = [np.zeros((width[a], width[b])) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(pairs, pair_tables):
            step = RATE * two_way(a, b)[0]
            table += step
            score += step[coarse[:, a], coarse[:, b]]
    return Model(base, edges, tables, pairs, pair_edges, pair_tables)


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    total = np.full(len(x), model.base)
    bins, coarse = _binned(x, model.edges), _binned(x, model.pair_edges)
    for j, table in enumerate(model.tables):
        total += table[bins[:, j]]
    for (a, b), table in zip(model.pairs, model.pair_tables):
        total += table[coarse[:, a], coarse[:, b]]
    return 1 / (1 + np.exp(-total))


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], "float64").reshape(len(texts), len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "quality", max_rows: int = MAX_LABELLED,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on about ``max_rows`` labelled rows at most that are ``learnable``."""
    sample = labelled_sample(docs, labels, label, learnable, max_rows, id_col, text_col)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast("string"), "label": batch.column(2).cast("int32"),
                "x": pa.array(list(_matrix(batch.column(1).to_pylist())), pa.list_(pa.float64()))})

    rows = stored(sample.mapInArrow(numbers, "doc_id string, label int, x array<double>"), "quality-sample").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([int(r["label"] > 0) for r in rows], "float64"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = predict(shared.value, _matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(s),
                                              "predicted": pa.array((s >= 0.5).astype("int32"))})

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(scored, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
