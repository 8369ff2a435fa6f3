"""Repeated byte strings: cut every byte covered by a string of ``length``
bytes that also starts anywhere else.

The suffixes that matter are found with a difference cover: of any two places,
some shift below ``COVER`` moves both to places whose remainder is in the
cover. So where a long string repeats, two cover places carry the same
``length - COVER + 1`` bytes, and only these sampled places are ranked over
the whole corpus (a place either has an equal or not). What the sample can't
decide is resolved block-wise, by sorting buckets (hash ranges that Spark
deals out) of the suffixes' first ``length`` bytes:

1. Of the suffixes that a repeated sample leaves open, those whose hash falls
   in a thin residue class are compared exactly. Equal strings choose equally,
   so the inside of every long repeat is covered by these.
2. Suffixes whose string isn't wholly covered yet are tested densely, against
   all suffixes of equal string: hashes alone first, then the places of those
   that stand more than once. Of a run of such places only some are sent, at most
   ``length`` bytes apart, as they cover what the run covers (``chosen``).

Only texts with open suffixes are read again after the first step. Hashes travel
packed, one row for each part of a batch (``dealt``), as a row each took most of
the engine's time.

The sample's result and the dense questions travel as bit filters: they only
leave out suffixes that can have no equal, so false hits cost rows, never results.
A false hit of the sample opens ``COVER`` suffixes, so that filter grows with the
repeated samples (``BITS_A_KEY``) up to a size that a worker can hold; with more
of them its hits are joined with the repeated samples, which leaves no false one.
The other filters have a fixed size, as they only choose among open suffixes.
Hashes are 64 bits of the whole string.

Defined cases: null and empty texts have no bytes and lose none; equal rows
are each other's repeats; rows are told apart by a hash of id and text; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import discard, release, stored
from shelfspark.llm.filters import BitFilter, bit_filter, in_filter, row_filter
from shelfspark.llm.shingles import batches, mix, powers

LENGTH = 400
COVER = 91
# fixed values: a perfect difference set, every remainder below COVER is a difference of two of them
RESIDUES = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
THIN = 32  # one of so many suffixes is compared in the first step
FILTER_BITS = 27  # of each of the three filters, at least
BITS_A_KEY, MOST_BITS = 64, 30  # of the filter of repeated samples
KEPT_POWERS = 1 << 21  # powers of the base that a worker keeps, at most
PIECE = 1 << 18  # bytes of texts whose open suffixes are handled at a time, as all of them may be open
PART_BITS = 9  # of a hash that name the part it is dealt to
_BASE = 0x5851F42D4C957F2D


_up, _down = powers(1), powers(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers of the base and of its inverse; those of usual batches are kept."""
    global _up, _down
    if n <= len(_up):
        return _up[:n], _down[:n]
    kept = max(n, KEPT_POWERS)
    up, down = powers(kept), powers(kept, pow(_BASE, -1, 2**64))
    if kept == KEPT_POWERS:
        _up, _down = up, down
    return up[:n], down[:n]


def cover_places(n: int) -> np.ndarray:
    """Places below ``n`` whose remainder is in the cover."""
    if n <= 0:
        return np.zeros(0, "int64")
    blocks = np.arange(0, n, COVER)[:, None] + np.array(RESIDUES)
    places = blocks.ravel()
    return places[places < n]


class Hasher:
    """Hashes of substrings of a batch of texts, all texts in one array."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"".join(texts), "uint8")
        self.sizes = np.array([len(t) for t in texts], "int64")
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        up, self.down = _powers(max(len(raw), 1))
        self.sums = np.zeros(len(raw) + 1, "uint64")
        np.add(raw, np.uint64(1), out=self.sums[1:])
        self.sums[1:] *= up[:len(raw)]
        np.cumsum(self.sums, out=self.sums)

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[places + length] - self.sums[places]) * self.down[places] + np.uint64(length))

    def sample(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Cover places of the texts of ``length`` bytes and more where the part of
        a string fits that the cover decides, and the texts they are in."""
        most = np.where(self.sizes >= length, self.sizes - (length - COVER), 0)  # places of a text
        places = cover_places(int(most.max(initial=0)))
        n = np.searchsorted(places, most)
        owner = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return self.starts[owner] + places[inside], owner


def filter_bits(n: int) -> int:
    """Size of the filter of ``n`` repeated samples: its share of false hits stays
    the same however many there are, as long as ``MOST_BITS`` hold them."""
    return min(max(FILTER_BITS, (BITS_A_KEY * n - 1).bit_length()), max(MOST_BITS, FILTER_BITS))


def hits(hasher: Hasher, repeated: BitFilter, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled places whose string may be repeated, the texts they are in, and their hashes."""
    sample, owner = hasher.sample(length)
    h = hasher.at(sample, length - COVER + 1)
    hit = in_filter(repeated, h)
    return sample[hit], owner[hit], h[hit]


def open_places(hasher: Hasher, repeated: BitFilter, length: int) -> np.ndarray:
    """Suffixes of a batch of texts that a repeated sample leaves open, in order
    (places in the array of all texts)."""
    return open_around(hasher, *hits(hasher, repeated, length)[:2], length)


def open_around(hasher: Hasher, sample: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Suffixes that repeated samples, in any order, leave open."""
    last = hasher.starts[owner] + hasher.sizes[owner] - length
    change = np.zeros(int(hasher.starts[-1]) + 2, "int32")
    np.add.at(change, np.maximum(sample - COVER + 1, hasher.starts[owner]), 1)
    np.add.at(change, np.minimum(sample, last) + 1, -1)
    return np.flatnonzero(np.cumsum(change))


def covered(found: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of ``n`` bytes the strings at the places ``found`` cover."""
    change = np.zeros(n + 1, "int32")
    np.add.at(change, found, 1)
    np.add.at(change, found + length, -1)
    return np.cumsum(change[:-1]) > 0


def chosen(rows: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places in order, row by row: which of them span their runs, neighbours at most
    ``length`` apart, and whether places next to them in the run are left out. Where both
    neighbours of such a gap start a repeated string, they cover all that the gap's places can."""
    same = (rows[1:] == rows[:-1]) & (places[1:] == places[:-1] + 1)
    first = np.concatenate([[True], ~same])[:len(places)]
    run = np.cumsum(first) - 1
    start, size = np.flatnonzero(first), np.bincount(run)
    at = np.arange(len(places)) - start[run]
    left = size[run] - 1 - at
    which = np.flatnonzero((at == 0) | (at % length == min(1, length - 1)) | (left <= 1))
    skipped = (run[which][1:] == run[which][:-1]) & (np.diff(which) > 1)
    gap = np.zeros(len(which), bool)
    gap[1:] |= skipped
    gap[:-1] |= skipped
    return which, gap


def _texts(batch: pa.RecordBatch, column: int = 1) -> Iterator[bytes]:
    return ((t.as_py() or "").encode("utf-8", "replace") for t in batch.column(column))


def _listed(hasher: Hasher, batch: pa.RecordBatch, index: int, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of a column of lists, in the array of the hasher's texts, and the texts they are in."""
    lists = batch.column(column).slice(index, len(hasher.sizes))
    owner = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).fill_null(0).to_numpy())
    return lists.flatten().to_numpy().astype("int64") + hasher.starts[owner], owner


def _per_batch(handle: Callable[[Hasher, pa.RecordBatch, int], np.ndarray]):
    """mapInArrow over (row, text, ...): handle(hasher, batch, index of the hasher's
    first text in it) gives places, which come out as (hash of length bytes, row, place)."""
    def run(found: Iterator[pa.RecordBatch], length: int, keep: Callable[[np.ndarray], np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows, index = batch.column(0).to_numpy(zero_copy_only=False), 0
            for part in batches(_texts(batch), PIECE):
                hasher = Hasher(part)
                p = handle(hasher, batch, index)
                h = hasher.at(p, length)
                if keep is not None:
                    ok = keep(h)
                    h, p = h[ok], p[ok]
                if len(p):
                    owner = np.searchsorted(hasher.starts, p, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(h.view("int64")), pa.array(rows[index + owner]),
                                                      pa.array((p - hasher.starts[owner]).astype("int32"))], names=["h", "row", "place"])
                index += len(part)
    return run


def _repeats(rows: DataFrame) -> DataFrame:
    """Hashes that stand in more than one row."""
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")


def dealt(hashes: np.ndarray) -> pa.RecordBatch:
    """part, hashes: one row for each part that unsigned hashes fall in, theirs as bytes.
    A hash is in them once, or twice if it stands more often, so a common one stays short."""
    h = np.sort(hashes)
    h = h[np.concatenate([np.ones(min(len(h), 2), bool), h[2:] != h[:-2]])]
    part = (h >> np.uint64(64 - PART_BITS)).astype("int32")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(h)]]) if len(h) else np.zeros(1, "int64")
    packed = [h[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(packed, "binary")], names=["part", "hashes"])


def repeated_hashes(parts: DataFrame) -> DataFrame:
    """h: hashes that stand more than once in rows of ``dealt``. A task holds one part at a time."""
    def repeated(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        h = np.sort(np.frombuffer(b"".join(held), "uint64"))
        again = h[1:][h[1:] == h[:-1]]
        if len(again):
            yield pa.RecordBatch.from_arrays([pa.array(again[np.concatenate([[True], again[1:] != again[:-1]])].view("int64"))], names=["h"])

    def find(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in found:
            for part, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != last and held:
                    yield from repeated(held)
                    held = []
                last = part
                held.append(hashes)
        if held:
            yield from repeated(held)

    return parts.repartition("part").sortWithinPartitions("part").mapInArrow(find, "h long")


def with_samples(docs: DataFrame, keys: DataFrame, repeated: Broadcast, length: int) -> DataFrame:
    """``docs`` and the places of each row's sample that are repeated (samples), none of them false."""
    def hit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows, index = batch.column(0).to_numpy(zero_copy_only=False), 0
            for texts in batches(_texts(batch)):
                hasher = Hasher(texts)
                places, owner, h = hits(hasher, repeated.value, length)
                if len(places):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view("int64")), pa.array(rows[index + owner]),
                                                      pa.array((places - hasher.starts[owner]).astype("int32"))], names=["h", "row", "place"])
                index += len(texts)

    true = docs.mapInArrow(hit, "h long, row long, place int").join(keys, "h", "left_semi")
    return stored(docs.join(true.groupBy("row").agg(F.collect_set("place").alias("samples")), "row", "left"), "sampled-texts")


def repeated_places(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, places: suffixes (in no order) whose first ``length`` bytes also start
    elsewhere, enough of them to cover all that such strings cover. ``docs``
    has row and text."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    part = length - COVER + 1

    def sample(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for texts in batches(_texts(batch)):
                hasher = Hasher(texts)
                places, _ = hasher.sample(length)
                if len(places):
                    yield dealt(hasher.at(places, part))

    keys = stored(repeated_hashes(docs.mapInArrow(sample, "part int, hashes binary")), "repeated-samples")
    release(spark)
    n = keys.count()
    bits = filter_bits(n)
    repeated = sc.broadcast(bit_filter(keys, bits))
    exact = BITS_A_KEY * n > 1 << bits
    if exact:
        docs = with_samples(docs, keys, repeated, length)
    discard(keys)
    release(spark)

    def open_of(hasher, batch, index):
        if exact:
            return open_around(hasher, *_listed(hasher, batch, index, "samples"), length)
        return open_places(hasher, repeated.value, length)

    def thin(found):
        opened: list[pa.Array] = []

        def of_batch(hasher, batch, index):
            places = open_of(hasher, batch, index)
            owner = np.unique(np.searchsorted(hasher.starts, places, "right") - 1)
            opened.append(batch.column(0).take(pa.array(index + owner)))
            return places

        yield from _per_batch(of_batch)(found, length, lambda h: (h & np.uint64(THIN - 1)) == 0)
        for rows in opened:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), "int64"), rows, pa.nulls(len(rows), "int32")], names=["h", "row", "place"])

    # the thin suffixes, and a row without a hash for every text that has open ones: only these texts are looked at again
    schema = "h long, row long, place int"
    every = stored(docs.mapInArrow(thin, schema), "thin-suffixes")
    first = every.where("h is not null")
    docs = docs.where(row_filter(every.where("h is null"), "row"))
    sure = first.join(stored(_repeats(first), "thin-repeats"), "h").groupBy("row").agg(F.collect_set("place").alias("places"))
    sure = stored(sure, "thin-places")
    release(spark)

    def unsure(found):
        def left(hasher, batch, index):
            places = open_of(hasher, batch, index)
            if "places" not in batch.schema.names or not len(places):
                return places
            known, _ = _listed(hasher, batch, index, "places")
            done = np.concatenate([[0], np.cumsum(covered(known, int(hasher.starts[-1]), length))])
            return places[done[places + length] - done[places] < length]

        # a filter asks which hashes there are, so equal ones of a batch are one
        for batch in _per_batch(left)(found, length, None):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(batch.column(0).to_numpy()))], names=["h"])

    # only documents with a place of the first step are shuffled to meet them
    has = row_filter(sure, "row")
    plain = docs.where(~has).mapInArrow(unsure, "h long")
    met = docs.where(has).join(sure, "row", "left").select(*docs.columns, "places").mapInArrow(unsure, "h long")
    asked = sc.broadcast(bit_filter(plain.union(met), FILTER_BITS))
    release(spark)

    # their hashes alone first; places only for those that do stand twice
    def asked_hashes(found):
        for batch in _per_batch(open_of)(found, length, lambda h: in_filter(asked.value, h)):
            yield dealt(batch.column(0).to_numpy().view("uint64"))

    twice = stored(repeated_hashes(docs.mapInArrow(asked_hashes, "part int, hashes binary")), "dense-repeats")
    asked.destroy()
    twice_bits = sc.broadcast(bit_filter(twice, FILTER_BITS))
    release(spark)

    def dense(found):
        return _per_batch(open_of)(found, length, lambda h: in_filter(twice_bits.value, h))

    def spanning(found):
        for batch in dense(found):
            which, gap = chosen(*(batch.column(c).to_numpy() for c in ("row", "place")), length)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(which)) for c in batch.columns), pa.array(gap)], names=[*batch.schema.names, "gap"])

    # of runs of places, those that span them; the whole runs only where one of these was a false hit
    spans = docs.mapInArrow(spanning, schema + ", gap boolean").join(twice.withColumn("true", F.lit(True)), "h", "left")
    spans = stored(spans.groupBy("row").agg(F.collect_set(F.when(F.col("true"), F.col("place"))).alias("places"),
                                            F.max(F.col("gap") & F.col("true").isNull()).alias("unknown")), "spanning-places")
    more, unknown = spans.where("not unknown and size(places) > 0").select("row", "places"), spans.where("unknown").select("row")
    if not unknown.isEmpty():
        whole = docs.where(row_filter(unknown, "row")).mapInArrow(dense, schema).join(twice, "h")
        more = more.unionByName(whole.groupBy("row").agg(F.collect_set("place").alias("places")))
    both = stored(sure.unionByName(more), "repeated-places")
    release(spark)
    return both.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start and end of every maximal removed run) and
    kept (the remaining bytes) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    places = repeated_places(rows.select("row", "text"), length)
    places = stored(places, "places")
    has = row_filter(places, "row")

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            n_bytes, spans, kept = [], [], []
            for i, t in enumerate(_texts(batch)):
                known, runs, rest = batch.column(2)[i], [], t
                if known.is_valid and len(t) >= length:
                    inside = covered(known.values.to_numpy().astype("int64"), len(t), length)
                    edge = np.diff(inside.astype("int8"), prepend=0, append=0)
                    runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
                    rest = np.frombuffer(t, "uint8")[~inside].tobytes()
                n_bytes.append(len(t))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, "int64"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, "binary")], names=["doc_id", "n_bytes", "spans", "kept"])

    none = F.lit(None).cast("array<int>").alias("places")
    whole = rows.where(~has).select("doc_id", "text", none)
    partly = rows.where(has).join(places, "row", "left").select("doc_id", "text", "places")
    schema = f"doc_id {id_type}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return whole.mapInArrow(cut, schema).unionByName(partly.mapInArrow(cut, schema))

