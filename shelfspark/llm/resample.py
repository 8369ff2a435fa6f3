"""Importance resampling of documents towards a target distribution.

Features are runs of consecutive words, hashed into buckets by the CRC-32 of
their bytes. A bucket's gain is the log ratio of its smoothed shares in the
target and in the documents; a document's weight is the sum of its features'
gains, and adding Gumbel noise of its id and taking the highest scores draws
documents without replacement in proportion to exp(weight).

The vocabulary has a head and a tail. Every task counts its words in a table of
bounded size that drops what is rare (each drop lowers all counts alike, so a
word of more than 1 / table size of a task's words can't be lost); summed over
tasks, the most frequent words are the head, whose CRC states (and for pairs,
whose buckets) are broadcast: at most HEAD entries of at most HEAD_BYTES bytes.
A feature out of the head takes its CRC directly. Both give the same bucket, so
the counts per bucket are exact whatever the head holds.

Defined cases: a null text has no word; a very long one is one row like any
other; documents with a null id have weight but no noise, so a null score, and
are neither counted nor drawn; repeated rows are counted and drawn each for
itself; ties of score go to the smaller id; without target or documents all
counts are 0 and the smoothing stands; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import ship_package, stored
from shelfspark.operators.tables import assign_ids

RUN = 1              # longest run of words that is a feature
BUCKETS = 10_000
HEAD = 1 << 15       # frequent words, and as many pairs, that are broadcast
HEAD_BYTES = 64      # longest feature of the head
COUNTED = 4 * HEAD   # entries of a task's table of counts
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10         # of the documents with at least LEAST_WORDS words are drawn

# bytes of a text: A to Z become lower case, what is neither letter, digit nor part of a non-ASCII character a blank
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Head(NamedTuple):
    """The frequent words with their CRC states, and the frequent pairs with their buckets."""
    states: dict[bytes, int]
    pairs: dict[tuple[bytes, bytes], int]


class _States(dict):
    """CRC state by word; a word out of the head is worked out, and not kept."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


class _PairBuckets(dict):
    """Bucket by pair; a pair out of the head goes on from its first word's state."""

    def __init__(self, known: dict, states: _States, buckets: int):
        super().__init__(known)
        self.states, self.buckets = states, buckets

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return crc32(b" " + pair[1], self.states[pair[0]]) % self.buckets


class Hasher:
    """Buckets of all features of a text."""

    def __init__(self, head: Head, run: int, buckets: int):
        self.run, self.buckets = run, buckets
        self.states = _States(head.states)
        self.pairs = _PairBuckets(head.pairs, self.states, buckets)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        states = np.fromiter(map(self.states.__getitem__, words), "int64", n)
        found = [states % self.buckets]
        if self.run > 1 and n > 1:
            found.append(np.fromiter(map(self.pairs.__getitem__, zip(words, words[1:])), "int64", n - 1))
        if self.run > 2:  # longer runs go on from the state of the run one word shorter
            spaced = [b" " + w for w in words]
            ends = [crc32(w, s) for w, s in zip(spaced[1:], states.tolist())]
            for length in range(3, self.run + 1):
                ends = [crc32(w, s) for w, s in zip(spaced[length - 1:], ends)]
                found.append(np.array(ends, "int64") % self.buckets)
        return np.concatenate(found)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column(batch.schema.get_field_index("text")):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _thin(counts: Counter, size: int) -> Counter:
    """The table cut to the ``size`` most frequent entries: all lose the count of
    the first that goes, like an item of a frequency sketch meeting others."""
    if len(counts) <= size:
        return counts
    least = sorted(counts.values(), reverse=True)[size]
    return Counter({w: c - least for w, c in counts.items() if c > least})


def _frequent(texts: DataFrame, run: int, head: int, buckets: int) -> Head:
    """The head of the vocabulary of all ``texts``."""
    limit = 4 * head

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Counter(), Counter()
        for batch in batches:
            for text in _texts(batch):
                found = words_of(text)
                # a very long text must not fill the table at once
                for a in range(0, len(found), limit):
                    words.update(found[a:a + limit])
                    if run > 1:
                        pairs.update(zip(found[a:a + limit], found[a + 1:a + limit + 1]))
                    if len(words) > 2 * limit:
                        words = _thin(words, limit)
                    if len(pairs) > 2 * limit:
                        pairs = _thin(pairs, limit)
        for first, counts in ((True, _thin(words, limit)), (False, _thin(pairs, limit))):
            kept = [(w if first else w[0], None if first else w[1], c) for w, c in counts.items()
                    if (len(w) if first else len(w[0]) + len(w[1]) + 1) <= HEAD_BYTES]
            for a in range(0, len(kept), 10_000):
                x, y, n = zip(*kept[a:a + 10_000])
                yield pa.RecordBatch.from_pydict({"word": pa.array(x, "binary"), "next": pa.array(y, "binary"), "n": pa.array(n, "int64")})

    counts = texts.mapInArrow(count, "word binary, next binary, n long").groupBy("word", "next").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), "word", "next"]
    counts = stored(counts.where("n > 1"), "head-counts")
    top = [counts.where(which).orderBy(*order).limit(head) for which in ("next is null", "next is not null")]
    states = {bytes(r["word"]): crc32(r["word"]) for r in top[0].collect()}
    found = top[1].collect() if run > 1 else []
    return Head(states, {(bytes(r["word"]), bytes(r["next"])): crc32(bytes(r["word"]) + b" " + bytes(r["next"])) % buckets for r in found})


def _bucket_totals(texts: DataFrame, hasher, buckets: int) -> np.ndarray:
    """How many features of all ``texts`` fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros(buckets, "int64"), hasher.value
        for batch in batches:
            for text in _texts(batch):
                total += np.bincount(of(words_of(text)), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(hit, "int32"), "n": total[hit]})

    total = np.zeros(buckets, "int64")
    for r in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]  # at most one row per bucket
    return total


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) per bucket."""
    buckets, s, t = len(documents), float(documents.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + buckets) / ((a + 1.0) * (t + buckets))))
                     for a, b in zip(documents.tolist(), target.tolist())], "int64")


def weigh(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, head: int = HEAD,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every document of ``docs``
    towards the texts of ``target``."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    goal = target.select(F.col(text_col).alias("text"))
    vocabulary = Hasher(_frequent(texts, run, head, buckets), run, buckets)
    shared = spark.sparkContext.broadcast(vocabulary)
    gain = spark.sparkContext.broadcast(gains(_bucket_totals(texts, shared, buckets), _bucket_totals(goal, shared, buckets)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, gain_of = shared.value, gain.value
        for batch in batches:
            rows = []
            for text in _texts(batch):
                words = words_of(text)
                found = of(words)
                rows.append((len(words), len(found), int(gain_of[found].sum())))
            if rows:
                words, features, weight = (pa.array(x, "int64") for x in zip(*rows))
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_words": words, "n_features": features, "weight": weight})

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return keyed.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of ``weigh`` with their score and the rank of the drawn ones."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "scored")
    may = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    n = scored.where(may).count()
    drawn = percent * n // 100
    ranked = assign_ids(scored.where(may).withColumn("_falling", -F.col("score")), ["_falling", "doc_id"], id_col="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.where(~may).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return ranked.select(*columns).unionByName(others.select(*columns))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) and n_words of every document."""
    return draw(weigh(docs, target, **options), percent)


# The same rows in SQL: CRC-32 by its bitwise definition, byte by byte, over the distinct words.
ORACLE = r"""
with recursive texts as (
  select 'd' as side, doc_id, text from documents union all select 't', null, text from benchmark),
words as (
  select side, doc_id, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w
  from texts),
counted as (select side, doc_id, w, count(*) as n from words where w <> '' group by all),
crc_table as (
  select b, list_reduce(list_prepend(b, range(8)),
    lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c
  from (select unnest(range(256))::bigint as b)),
step as (
  select w, hex(encode(w)) as bytes, 0 as i, 4294967295::bigint as crc from (select distinct w from counted)
  union all
  select w, bytes, i + 1, xor(crc // 256, t.c)
  from step join crc_table t on t.b = xor(crc % 256, ('0x' || substr(bytes, 2 * i + 1, 2))::bigint)
  where 2 * i < length(bytes)),
buckets as (select w, xor(crc, 4294967295) % 10000 as bucket from step where 2 * i = length(bytes)),
per_bucket as (
  select bucket, sum(n) filter (where side = 'd') as s, sum(n) filter (where side = 't') as t
  from counted join buckets using (w) group by bucket),
whole as (select coalesce(sum(s), 0) as s, coalesce(sum(t), 0) as t from per_bucket),
gain as (
  select p.bucket, floor(1000 * ln((coalesce(p.t, 0) + 1.0::double) * (whole.s + 10000.0::double)
    / ((coalesce(p.s, 0) + 1.0::double) * (whole.t + 10000.0::double))))::bigint as g
  from per_bucket p, whole),
weights as (
  select doc_id, sum(n) as n, sum(n * g) as weight
  from counted join buckets using (w) join gain using (bucket) where side = 'd' group by doc_id),
scored as (
  select d.doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double)
      / 4294967296.0::double)))::bigint as score
  from documents d left join weights using (doc_id)),
ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as r from scored where n_features >= 20)
select doc_id, n_features, weight, score,
  case when r <= (select 10 * count(*) // 100 from ranked) then r end as rank
from scored left join ranked using (doc_id)
"""
