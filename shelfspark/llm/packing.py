"""Best-fit packing of tokenised documents into sequences of bounded length.

Hierarchical residual packing: the documents are cut into pieces where they
are; the pieces (without their texts) are dealt out by chance, so that every
task gets all sizes, and packed best-fit (longest first); bins that are nearly
full are done. The underfull bins, now items themselves, are dealt out by
chance again, to as many tasks as keep the number of items per task bounded,
and packed again, until one task holds them or a round saves less than a
sequence per task. Every round is checkpointed, so a lost executor repeats a
task with the same result and nothing is tokenised twice.

Defined cases: null and empty texts are the single closing token; repeated
rows are packed once per row; null ids are kept; an empty table gives no
rows; other columns of ``docs`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import checkpoint_dir

CAPACITY = 4096
NEARLY_FULL = 0.995  # share of the capacity from which a bin is done
ITEMS_PER_TASK = 10_000  # underfull bins that one merging task reads, at most on average
CHUNK = 100_000  # pieces that a task packs at a time
CACHED_WORDS = 300_000  # entries of each of a worker's two token caches
END_ID = 1

# what str.split() takes for white space and the tokenizer's pattern doesn't
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes for the characters from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class TokenBytes(dict):
    """White-space separated chunk -> its ids as little-endian 32-bit bytes.

    No alternative of the tokenizer's pattern matches white space, so the ids
    of a text are those of its chunks, one after the other. Chunks of letters
    with at most one closing mark are tokenised by word, through a second cache;
    all others by the tokenizer itself."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters, self.words, self.cached = _byte_letters(), {}, cached
        self.tokenize = self.tokenizer.model.tokenize

    def word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            spelled = word.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(spelled)])
            if len(self.words) < self.cached:
                self.words[word] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        # below U+0130 lower case goes letter by letter and texts are in composed form
        if max(chunk) < "İ" and (chunk.isalpha() or (chunk[-1] in ".,;:!?" and chunk[:-1].isalpha())):
            low = chunk.lower()
            ids = self.word(low) if chunk[-1].isalpha() else self.word(low[:-1]) + self.word(low[-1])
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < self.cached:
            self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        if any(c in text for c in _SEPARATORS):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


_LOADED: dict[str, TokenBytes] = {}  # a worker's tokenizer, kept between its tasks


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: doc_id, piece, start,
    length, ids_crc32 and, with ``keep_ids``, the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _LOADED:
            _LOADED[tokenizer_path] = TokenBytes(tokenizer_path)
        tokens, end, step = _LOADED[tokenizer_path], END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            row, piece, length, crc, kept = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = tokens.text(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    row.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<u4").astype("int32"))
            columns = {"doc_id": batch.column(0).take(pa.array(row, "int64")), "piece": pa.array(piece, "int32"),
                       "start": pa.array([k * capacity for k in piece], "int64"), "length": pa.array(length, "int64"),
                       "ids_crc32": pa.array(crc, "int64")}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if keep_ids else {}))

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(cut, f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, "
                             "length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack items longest first, each into the fullest bin that takes it:
    bin and offset of every item, and the words used in every bin."""
    bins, offsets, used = np.empty(len(sizes), "int64"), np.empty(len(sizes), "int64"), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with r free places exists
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(used, "int64")


def _packer(level: int, capacity: int, done: float):
    """A mapInArrow function: rows of pieces with the bin that holds them ->
    the same rows in larger bins."""

    def pack_rows(rows: pa.Table, bin_of: np.ndarray, inside: np.ndarray, first: int) -> tuple[list[pa.RecordBatch], int]:
        _, item = np.unique(bin_of, return_inverse=True)
        sizes = np.bincount(item, weights=rows["length"].to_numpy()).astype("int64")
        bins, offsets, used = best_fit(sizes, capacity)
        part = TaskContext.get().partitionId()
        new = {"sequence_id": (level << 58) + (part << 30) + first + bins[item], "offset": inside + offsets[item],
               "used": used[bins[item]], "done": used[bins[item]] >= done * capacity}
        for name, values in new.items():
            rows = rows.append_column(name, pa.array(values))
        return rows.take(pa.array(np.argsort(bins[item], kind="stable"))).to_batches(), first + len(used)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, first = [], 0, 0

        def packed():
            rows = pa.Table.from_batches(held)
            if level == 0:  # every piece is a bin of its own
                return pack_rows(rows, np.arange(n), np.zeros(n, "int64"), first)
            bin_of, inside = rows["sequence_id"].to_numpy(), rows["offset"].to_numpy()
            return pack_rows(rows.drop_columns(["sequence_id", "offset", "used", "done"]), bin_of, inside, first)

        for batch in batches:
            if batch.num_rows:
                held, n = [*held, batch], n + batch.num_rows
            if level == 0 and n >= CHUNK:
                out, first = packed()
                yield from out
                held, n = [], 0
        if held:
            yield from packed()[0]

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL,
         items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Place every piece: its columns, sequence_id and offset."""
    checkpoint_dir(pieces.sparkSession)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    schema = f"{columns}, sequence_id long, offset long, used long, done boolean"
    n_bins = F.count_distinct(F.when(~F.col("done"), F.col("sequence_id")))
    # dealt by chance: sources or sizes that lie in different partitions must meet
    dealt = pieces.withColumn("__deal", F.xxhash64(F.monotonically_increasing_id())).repartition("__deal").drop("__deal")
    packed = dealt.mapInArrow(_packer(0, capacity, nearly_full), schema).checkpoint()
    finished, level, open_bins = [], 0, packed.agg(n_bins).first()[0]
    while True:
        finished.append(packed.where("done"))
        tasks = -(-open_bins // items_per_task)
        if not open_bins:
            break
        left, level = packed.where(~F.col("done")), level + 1
        mixed = left.coalesce(1) if tasks == 1 else left.repartition(tasks, F.xxhash64("sequence_id", F.lit(level)))
        packed = mixed.mapInArrow(_packer(level, capacity, nearly_full), schema).checkpoint()
        before, open_bins = open_bins, packed.agg(n_bins).first()[0]
        saved = before - packed.agg(F.count_distinct("sequence_id")).first()[0]
        if tasks == 1 or saved < tasks:
            finished.append(packed)
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.drop("used", "done")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece with its place."""
    return pack(tokenised_pieces(docs, tokenizer_path, capacity, keep_ids, id_col, text_col), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The training sequences themselves, from a packing with ids: sequence_id,
    ids and the documents in them. A group is one sequence, so it is bounded."""
    return (placed.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
                    F.transform("p", lambda x: x["doc_id"]).alias("doc_ids")))
