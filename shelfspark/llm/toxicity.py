"""Toxicity by cumulative-link ordinal regression on sparse word and stem counts.

P(grade > k) = sigmoid(w.x - t_k): one weight per word or stem, shared by all ordered
thresholds t_k. The vocabulary (words whose presence goes with the label) is
counted by Spark over the labelled sample; the fit itself sees only the sparse
rows of that sample (at most ``MAX_LABELLED`` on average). Binary labels are
graded: 0 clean, and labelled texts 1 or 2 by whether the share of strongly
indicative words is above the median of the labelled texts. Labels with more
grades are taken as they are.

Output per document: expected severity (sum over k of P(grade > k)), the
probability of any toxicity and the decision.

Defined cases: null and empty texts have no words and get the intercept's
score, but are never rejected; rows with null label or id aren't learnt from;
without any labelled toxic row nothing is rejected and the severity is 0;
repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import labelled_sample, stored
from shelfspark.llm.shingles import BATCH_BYTES

MAX_LABELLED = 20_000
MAX_WORDS = 4_000  # vocabulary
MIN_DOCS = 4  # labelled documents that a word of the vocabulary is in, at least
INDICATIVE = 3.0  # z value of the log odds from which a word counts for the grade
RIDGE = 1e-5
ITERATIONS = 400
STEMS = (4, 5)  # letters of the stems that are features beside the words

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _counted(words: dict[str, int], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value, log(1 + count), of the sparse features: words,
    and the stems (first letters) of longer words, which end in ``*``."""
    row, col, val, get = array("q"), array("q"), array("q"), words.get
    for i, text in enumerate(texts):
        found: dict[int, int] = {}
        for word, n in Counter(_WORD.findall((text or "").lower())).items():
            for name in (word, *[word[:k] + "*" for k in STEMS if len(word) > k]):
                if at := get(name):
                    found[at] = found.get(at, 0) + n
        row.extend(repeat(i, len(found)))
        col.extend(found.keys())
        val.extend(found.values())
    return np.array(row, "int64"), np.array(col, "int64") - 1, np.log1p(np.array(val, "float64"))


def _pieces(found: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches in runs of rows with about ``BATCH_BYTES`` of text in ``column``,
    so that a worker's memory doesn't follow the size of Spark's batches."""
    for batch in found:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes + 1, dtype="int64") // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def vocabulary(sample: DataFrame) -> list[tuple[str, float]]:
    """Words by the z value of their log odds of standing in a toxic text."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))

    def stems(k: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    word = F.explode(F.array_distinct(F.concat(words, *[stems(k) for k in STEMS]))).alias("word")
    toxic = (F.col("label") > 0).cast("long")
    sizes = sample.agg(F.sum(toxic), F.count(F.lit(1))).first()
    n1, n = int(sizes[0] or 0), int(sizes[1])
    if not n1 or n1 == n:
        return []
    seen = sample.select(toxic.alias("toxic"), word).groupBy("word").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("b"))
    a, c = F.col("a") + 0.5, F.col("b") - F.col("a") + 0.5
    odds = F.log(a / (n1 + 1 - a)) - F.log(c / (n - n1 + 1 - c))
    z = odds / F.sqrt(1 / a + 1 / c)
    rows = (seen.where(F.col("b") >= MIN_DOCS).select("word", z.alias("z"))
            .orderBy(F.abs("z").desc(), "word").limit(MAX_WORDS).collect())
    return [(r["word"], r["z"]) for r in rows]


def fit_ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the ridge-penalised
    cumulative-link likelihood (numpy, deterministic)."""
    n, top = len(grade), int(grade.max())
    above = (grade[:, None] > np.arange(top)[None, :]).astype("float64")  # n x thresholds
    w = np.zeros(n_words)
    first = -np.log((above.mean(0) + 1e-4) / (1 - above.mean(0) + 1e-4))
    cut = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])  # the gaps stay positive
    m, v = np.zeros(n_words + top), np.zeros(n_words + top)
    for step in range(1, ITERATIONS + 1):
        t = cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])
        score = np.bincount(row, weights=val * w[col], minlength=n)
        p = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -35, 35)))  # P(grade > k)
        p = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        i = np.arange(n)
        hi, lo = p[i, grade], p[i, grade + 1]
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        d_score = -(d_hi - d_lo) / n  # of the negative mean log likelihood
        d_t = np.zeros(top)
        np.add.at(d_t, grade[grade > 0] - 1, (d_hi / n)[grade > 0])
        np.add.at(d_t, grade[grade < top], (-d_lo / n)[grade < top])
        d_cut = np.concatenate([[d_t.sum()], np.exp(cut[1:]) * np.cumsum(d_t[::-1])[::-1][1:]])
        g = np.concatenate([np.bincount(col, weights=val * d_score[row], minlength=n_words) + RIDGE * w, d_cut])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, cut = w - move[:n_words], cut - move[n_words:]
    return w, cut[0] + np.concatenate([[0], np.cumsum(np.exp(cut[1:]))])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_LABELLED,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    sample = stored(labelled_sample(docs, labels, label, F.lit(True), max_rows, id_col, text_col), "toxicity-sample")
    ranked = vocabulary(sample)
    if not ranked:
        return Model()
    words = {w: i + 1 for i, (w, _) in enumerate(ranked)}
    strong = np.array([z >= INDICATIVE for _, z in ranked])
    shared = sample.sparkSession.sparkContext.broadcast(words)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            texts = batch.column(1).to_pylist()
            row, col, val = _counted(shared.value, texts)
            ends = np.searchsorted(row, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast("string"), "label": batch.column(2).cast("int32"),
                "n": pa.array([len(_WORD.findall(t)) for t in texts], "int64"),
                "col": pa.array([col[a:b] for a, b in zip(ends, ends[1:])], pa.list_(pa.int64())),
                "val": pa.array([val[a:b] for a, b in zip(ends, ends[1:])], pa.list_(pa.float64()))})

    rows = sample.mapInArrow(sparse, "doc_id string, label int, n long, col array<long>, val array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["n"]))
    sizes = [len(r["col"]) for r in rows]
    row = np.repeat(np.arange(len(rows)), sizes)
    col = np.array([c for r in rows for c in r["col"]], "int64")
    val = np.array([x for r in rows for x in r["val"]], "float64")
    grade = np.maximum(np.array([r["label"] for r in rows], "int64"), 0)
    if grade.max() == 1:
        hits = np.bincount(row, weights=np.expm1(val) * strong[col], minlength=len(rows))
        share = hits / np.maximum([r["n"] for r in rows], 1)
        grade = grade + ((grade == 1) & (share > np.median(share[grade == 1])))
    return Model(words, *fit_ordinal(row, col, val, grade, len(words)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``) with severity, p_toxic and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = keep or [id_col]
    n_kept = len(kept)
    at = kept.index(text_col) if text_col in kept else n_kept  # a text that is kept isn't sent twice

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in _pieces(batches, at):
            n = batch.num_rows
            p = np.zeros((n, 1))
            if len(m.weights):
                row, col, val = _counted(m.words, batch.column(at).to_pylist())
                total = np.bincount(row, weights=val * m.weights[col], minlength=n)
                p = 1 / (1 + np.exp(np.clip(m.thresholds[None, :] - total[:, None], -700, 700)))
            texts = batch.column(at)
            given = np.array([bool(t) for t in texts.is_valid().to_pylist()], bool)
            made = [pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p[:, 0] >= 0.5) & given)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *made], names=names)

    fields = [docs.schema[c] for c in kept]
    names = [f"k{i}" for i in range(n_kept)] + ["severity", "p_toxic", "toxic"]
    schema = ", ".join([f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)])
    narrow = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], *([F.col(text_col).alias("text")] if at == n_kept else []))
    out = narrow.mapInArrow(predict, f"{schema}, severity double, p_toxic double, toxic boolean")
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(kept)})


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that aren't rejected as toxic."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col)
    kept = docs.columns
    scored = score(docs.toDF(*[f"c{i}" for i in range(len(kept))]), model, f"c{kept.index(id_col)}",
                   f"c{kept.index(text_col)}", [f"c{i}" for i in range(len(kept))])
    return scored.where(~F.col("toxic")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)])
