"""Bit filters of a fixed size: which hashes can be in a table. They only
leave out what can't match; a full filter costs rows, never results."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import stored

CHUNKS = 64  # that a filter travels in
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
ROW_BITS = 23  # of the filters inside the engine


class BitFilter:
    """A blocked Bloom filter of ``2**bits`` bits: the top bits of a hash name its
    chunk, and PROBES slots in it are set. It travels compressed."""

    def __init__(self, bits: int, chunks: dict[int, bytes]):
        self.bits, self.chunks, self._table = bits, chunks, None

    def __getstate__(self):
        return {"bits": self.bits, "chunks": self.chunks, "_table": None}

    @property
    def table(self) -> np.ndarray:
        if self._table is None:
            table = np.zeros((CHUNKS, (1 << (self.bits - 3)) // CHUNKS), "uint8")
            for c, packed in self.chunks.items():
                table[c] = np.frombuffer(zlib.decompress(packed), "uint8")
            self._table = table.ravel()
        return self._table


def _slot(hashes: np.ndarray, odd: int, bits: int) -> np.ndarray:
    """Slot of the hashes inside their chunk, by one of PROBES."""
    return (hashes * np.uint64(odd)) >> np.uint64(64 - (bits - 6))


def bit_filter(hashes: DataFrame, bits: int) -> BitFilter:
    """Filter over the well-mixed 64-bit numbers in the first column."""
    size = (1 << (bits - 3)) // CHUNKS

    def collect(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in found:
            h = batch.column(0).to_numpy(zero_copy_only=False).view("uint64")
            chunk = (h >> np.uint64(58)).astype("int64")
            for c in np.unique(chunk).tolist():
                table = tables.setdefault(c, np.zeros(size, "uint8"))
                for slot in (_slot(h[chunk == c], odd, bits) for odd in PROBES):
                    np.bitwise_or.at(table, (slot >> np.uint64(3)).astype("int64"), np.uint8(1) << (slot & np.uint64(7)).astype("uint8"))
        for c, table in tables.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], "int32"), "bits": pa.array([zlib.compress(table.tobytes(), 1)], "binary")})

    # dealt by chunk: the rows of one chunk meet in one task
    dealt = hashes.toDF("h").repartition(CHUNKS, F.shiftrightunsigned("h", 58))
    return BitFilter(bits, {r["chunk"]: bytes(r["bits"]) for r in dealt.mapInArrow(collect, "chunk int, bits binary").collect()})


def in_filter(found: BitFilter, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes can be in the filter."""
    left = np.arange(len(hashes))
    for odd in PROBES:
        some = hashes[left]  # only those that no probe has ruled out
        at = ((some >> np.uint64(58)) << np.uint64(found.bits - 6)) + _slot(some, odd, found.bits)
        left = left[(found.table[(at >> np.uint64(3)).astype("int64")] >> (at & np.uint64(7)).astype("uint8") & 1).astype(bool)]
    out = np.zeros(len(hashes), bool)
    out[left] = True
    return out


def row_filter(rows: DataFrame, column: str) -> Column:
    """Condition on the 64-bit hash ``column``, inside the engine: whether it
    can be in ``rows``. The table is an array of longs in a scalar subquery."""
    n = 1 << (ROW_BITS - 6)
    slot = F.pmod(column, F.lit(1 << ROW_BITS)).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = rows.select(F.shiftright(slot, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = rows.sparkSession.range(n).select(F.col("id").alias("at")).join(words, "at", "left")
    listed = F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    table = stored(every.agg(F.transform(listed, lambda x: x["bits"]).alias("bits")), "row-filter").scalar()
    word = F.get(table, F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, F.pmod(slot, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
