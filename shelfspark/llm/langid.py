"""Language id by cross-parsing entropy.

For every language one suffix automaton is built from a bounded sample of its
labelled text. A text is parsed greedily against each automaton into longest
matches (phrases); the language with the smallest code length, phrases times
the bits of a pointer into its sample, wins. The automata are dense tables, so
all texts of a batch advance through all languages together, one character a
step, in numpy.

Texts are lower-cased letters with every run of other characters as one
separator. Whole texts are parsed; texts over ``LANE`` characters go through
in lanes of that many, which costs one phrase per lane in every language.

Defined cases: texts that are null, empty or without a letter get ``und`` with
score 0; rows with null language, text or id are not learnt from; a null id is
not held out; without any labelled row every text is ``und``; ties go to the
smaller language name; repeated rows are scored alike; other columns are not
read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import stored

SAMPLE_DOCS = 64  # labelled documents read per language, at most
SAMPLE_CHARS = 16_000  # normalised characters learnt per language, at most
SYMBOLS = 160  # frequent letters with a symbol of their own; the others share SHARED symbols
SHARED = 32
LANE = 2048
BATCH_CHARS = 1_500_000


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # code point -> symbol, 0 for all but letters
    table: np.ndarray  # (state offset + symbol) -> next state offset * 2 + 1 if a phrase begins
    start: np.ndarray  # state offset before the first character, by language
    bits: np.ndarray  # of one phrase, by language


def _letters() -> np.ndarray:
    """Code point of the lower-case letter, 0 for all that is no letter."""
    out = np.zeros(0x110000, "uint32")
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def _squeezed(symbols: np.ndarray) -> np.ndarray:
    """Runs of separators become one."""
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    return symbols[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


def build(texts: dict[str, str]) -> Model:
    """Automata of the sample texts, as one dense table."""
    letters = _letters()
    folded = {lang: letters[_codes(texts[lang])] for lang in sorted(texts)}
    counts: Counter = Counter()
    for codes in folded.values():
        counts.update(dict(zip(*(x.tolist() for x in np.unique(codes[codes > 0], return_counts=True)))))
    own = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:SYMBOLS]]
    n_symbols = 1 + len(own) + SHARED
    of_letter = 1 + len(own) + np.arange(0x110000) % SHARED
    of_letter[own] = 1 + np.arange(len(own))
    of_letter[0] = 0
    symbol = of_letter[letters].astype("uint8")
    tables, start, bits, base = [], [], [], 0
    for lang, codes in folded.items():
        learnt = _squeezed(of_letter[codes])[:SAMPLE_CHARS]
        step = suffix_automaton(learnt.tolist())
        dead = len(step)  # before the first character, and after one that the sample hasn't
        first = np.full(n_symbols, dead, "int64")
        for c, to in step[0].items():
            first[c] = to
        table = np.tile((base + first * n_symbols) * 2 + 1, (dead + 1, 1))
        for state, moves in enumerate(step):
            for c, to in moves.items():
                table[state, c] = (base + to * n_symbols) * 2
        tables.append(table.ravel())
        start.append(base + dead * n_symbols)
        bits.append(np.log2(len(learnt) + 2))
        base += table.size
    flat = np.concatenate(tables) if tables else np.zeros(0, "int64")
    return Model(list(folded), symbol, flat.astype("int32" if base < 2**30 else "int64"),
                 np.array(start, "int64"), np.array(bits))


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases of every text (symbols) against every language."""
    owner, lanes = [], []
    for i, t in enumerate(texts):
        for at in range(0, len(t), LANE):
            owner.append(i)
            lanes.append(t[at:at + LANE])
    counts = np.zeros((len(model.languages), len(texts)))
    if not lanes or not model.languages:
        return counts.T
    order = sorted(range(len(lanes)), key=lambda i: -len(lanes[i]))
    lengths = np.array([len(lanes[i]) for i in order])
    grid = np.zeros((lengths[0], len(order)), "uint8")
    for j, i in enumerate(order):
        grid[: lengths[j], j] = lanes[i]
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # lanes longer than t
    state = np.repeat(model.start.astype(model.table.dtype)[:, None], len(order), axis=1)
    begun = np.zeros(state.shape, "int32")
    for t in range(lengths[0]):
        n = alive[t]
        to = model.table.take(state[:, :n] + grid[t, :n])
        begun[:, :n] += to & 1
        state[:, :n] = to >> 1
    who = np.array(owner)[order]
    for k in range(len(model.languages)):
        counts[k] = np.bincount(who, weights=begun[k], minlength=len(texts))
    return counts.T


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score (its share of the code lengths' probabilities)."""
    symbols = [_squeezed(model.symbol[_codes(t or "")]) for t in texts]
    bits = phrases(model, symbols) * model.bits
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    best = bits.argmin(axis=1)
    gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 700)
    score = 1 / np.exp2(-gap).sum(axis=1)
    known = np.array([bool(s.any()) for s in symbols], bool)
    return [model.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, score, 0.0)


def learn(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most SAMPLE_DOCS documents per language, those with the
    smallest hashes of their id, and SAMPLE_CHARS characters of each language."""
    seen = (docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
            .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h")))
    counts = stored(seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langs")
    share = F.least(F.lit(1.0), F.lit(3.0 * SAMPLE_DOCS) / F.col("n"))
    near = (seen.join(counts, "lang").where(F.col("h") <= (share - F.lit(0.5)) * F.lit(2.0**64))
            .select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text")))
    order = Window.partitionBy("lang").orderBy("h", "text")
    rows = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return build({lang: " ".join(t) for lang, t in texts.items()})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, languages, scores, at = batch.column(1), [], [], 0
            while at < len(texts):
                part, n = [], 0
                while at < len(texts) and n < BATCH_CHARS:
                    part.append(texts[at].as_py())
                    n, at = n + len(part[-1] or ""), at + 1
                found, score = classify(shared.value, part)
                languages += found
                scores.append(score)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "lang_pred": pa.array(languages, "string"),
                "score": pa.array(np.concatenate(scores) if scores else np.zeros(0))})

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double")
