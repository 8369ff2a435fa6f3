"""N-gram Jaccard join, size-aware: subsets of small sets, lists of large ones.

Equal sets are one class. Two classes of sizes a and b link when they share at
least c(a, b) shingles. Small sets are written out as all their subsets of the
sizes c that partners ask for; sets that share a subset link without further
counting, so each subset's group is a star around its smallest set. Large sets
are entered into the inverted lists of their rarest shingles (as many as any
link must touch); rarity is counted over all documents in a fixed number of
counters. The boundary between small and large is the size with the smallest
estimated number of subsets and list entries.

A list is never written out as all pairs: it proposes its members against one
or two hubs per band of sizes, proposals are verified on the whole sets, and only
members that still lie in different components are then compared with each
other. So the components are exact while a group of thousands of near copies
costs a few comparisons per member.

Defined cases: null, empty and blank texts have size 0 and link with nothing;
texts shorter than a shingle are one shingle; rows with a null id link with
nothing and have a null component; equal ids and equal texts are rows of one
class; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import discard, release, stored
from shelfspark.llm.components import connected_components
from shelfspark.llm.filters import bit_filter, in_filter, row_filter
from shelfspark.llm.shingles import mix, set_ids, shingle_sets

COUNTER_BITS = 20  # counters of the rarity of shingles: a fixed number, shared by hash
CHUNKS = 64  # that they travel in
LIST_COST = 4.0  # of an entry of an inverted list, in subsets
LARGEST_SMALL = 40  # sizes tried as the boundary
KEY_FILTER_BITS = 26  # of the filter of the keys that several entries share: a fixed size
MANY = 8  # members from which a list has a second hub
BITMAP_LEAST, BITMAP_MOST = 64, 1 << 16  # bits of a set's bitmap, a power of two from its size on


def shared_least(a: int, b: int, num: int, den: int) -> int:
    """Shingles that sets of sizes a and b must share to link."""
    return -(-num * (a + b) // (num + den))


def _shared_least(a: Column, b: Column, num: int, den: int) -> Column:
    return F.ceil((a + b) * F.lit(num) / F.lit(float(num + den)) - F.lit(1e-9))


def subset_sizes(size: int, boundary: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets that small partners of a set of ``size`` ask for."""
    partners = range(-(-num * size // den), min(boundary, size * den // num) + 1)
    return sorted({shared_least(size, b, num, den) for b in partners if shared_least(size, b, num, den) <= min(size, b)})


def _prefix(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def boundary_by_cost(histogram: dict[int, int], num: int, den: int) -> int:
    """Largest size of small sets, by the estimated cost of subsets and lists."""
    def cost(x: int) -> float:
        small = sum(n * sum(math.comb(s, c) for c in subset_sizes(s, x, num, den)) for s, n in histogram.items() if s <= x)
        large = sum(n * LIST_COST * _prefix(s, num, den) for s, n in histogram.items() if den * s >= num * (x + 1))
        return small + large

    return min(range(LARGEST_SMALL + 1), key=lambda x: (cost(x), x))


def bitmaps(sets: list[np.ndarray]) -> list[bytes]:
    """A bitmap of every set: each shingle flips the bit of its last digits. So two
    bitmaps differ in no more bits than the sets do in shingles."""
    sizes = np.array([len(s) for s in sets], "int64")
    wide = np.clip(2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype("int64"), BITMAP_LEAST, BITMAP_MOST)
    first = np.cumsum(wide) - wide
    at = (np.concatenate(sets) & np.repeat(wide - 1, sizes).astype("uint64")).astype("int64") + np.repeat(first, sizes)
    packed = np.packbits((np.bincount(at, minlength=int(wide.sum())) & 1).astype("uint8"), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((first // 8).tolist(), ((first + wide) // 8).tolist())]


def least_difference(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the shorter one's bits."""
    one, other = (np.frombuffer(b, "uint64") for b in (x, y))
    least = min(len(one), len(other))
    folded = (np.bitwise_xor.reduce(b.reshape(-1, least), axis=0) for b in (one, other))
    return int(np.bitwise_count(np.bitwise_xor(*folded)).sum())


def _sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n, set, bits) of the documents, and the counters of rarity (chunk, counts)."""
    def scan(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, "uint32")
        for batch in found:
            sizes, ids, bits = [], [], []
            for sets in shingle_sets((t.as_py() for t in batch.column(1)), words):
                np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS)).astype("int64"), np.uint32(1))
                sizes += [len(s) for s in sets]
                ids += set_ids(sets)
                bits += bitmaps(sets)
            n, id_type = len(sizes), batch.column(0).type
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, "int32"), pa.array(ids, "int64"), pa.array(bits, "binary"),
                                              pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if counts.any():
            parts = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(CHUNKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, id_type), pa.nulls(CHUNKS, pa.int32()), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.binary()),
                                              pa.array(range(CHUNKS), "int32"), pa.array(parts, "binary")], names=names)

    names = ["doc_id", "n", "set", "bits", "chunk", "counts"]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(scan, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n int, set long, bits binary, chunk int, counts binary")


def _rarity(scanned: DataFrame) -> np.ndarray:
    """Class of every counter (bits of its count): the order of shingles."""
    def total(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in found:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(zlib.decompress(counts), "uint32").astype("uint64")
                sums[chunk] = sums[chunk] + new if chunk in sums else new
        bits = [np.ceil(np.log2(s.astype("float64") + 1)).astype("uint8").tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), "int32"), "bits": pa.array(bits, "binary")})

    rows = (scanned.where(F.col("chunk").isNotNull()).select("chunk", "counts").repartition(CHUNKS, "chunk")
            .mapInArrow(total, "chunk int, bits binary").collect())
    out = np.zeros((CHUNKS, (1 << COUNTER_BITS) // CHUNKS), "uint8")
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["bits"], "uint8")
    return out.ravel()


def _entries(docs: DataFrame, rarity: np.ndarray, boundary: int, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (key, c, set, n, pos): a subset of size c of a small set, or a
    place in an inverted list (c = 0) of a set that large ones may ask for."""
    order = docs.sparkSession.sparkContext.broadcast(rarity)
    wanted = {s: subset_sizes(s, boundary, num, den) for s in range(boundary + 1)}

    def entered(s: np.ndarray) -> list[tuple[np.ndarray, int]]:
        n, made = len(s), []
        if n <= boundary:
            scattered = mix(s)
            for c in wanted[n]:
                left_out = np.array(list(combinations(range(n), n - c)), "int64").reshape(math.comb(n, c), n - c)
                rest = scattered.sum(dtype="uint64", keepdims=True) - scattered[left_out].sum(axis=1, dtype="uint64")
                made.append((mix(rest + np.uint64(c)), c))
        if den * n >= num * (boundary + 1):
            rare = order.value[(s >> np.uint64(64 - COUNTER_BITS)).astype("int64")]
            made.append((s[np.lexsort((s, rare))[:_prefix(n, num, den)]], 0))
        return made

    def enter(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for sets in shingle_sets((t.as_py() for t in batch.column(0)), words):
                rows = [(key, c, name, len(s)) for s, name in zip(sets, set_ids(sets)) if len(s) for key, c in entered(s)]
                if rows:
                    sizes = [len(key) for key, *_ in rows]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([key for key, *_ in rows]).view("int64")),
                        *[pa.array(np.repeat(np.array([r[i] for r in rows], kind), sizes)) for i, kind in ((1, "int32"), (2, "int64"), (3, "int32"))],
                        pa.array(np.concatenate([np.arange(n, dtype="int32") for n in sizes]))], names=["key", "c", "set", "n", "pos"])

    return docs.where(F.col(id_col).isNotNull()).select(text_col).mapInArrow(enter, "key long, c int, set long, n int, pos int")


def _may_share(classes: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose bitmaps differ in no more bits than linked
    sets may. It leaves out only pairs that can't link, so few texts travel."""
    def test(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            sizes, bits = (zip(batch.column(i).to_pylist(), batch.column(i + 1).to_pylist()) for i in (2, 4))
            ok = [least_difference(x, y) <= m + n - 2 * shared_least(m, n, num, den) for (m, x), (n, y) in zip(sizes, bits)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, "bool"))

    def side(end: str) -> DataFrame:
        return classes.select(F.col("set").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return stored(both.mapInArrow(test, "a long, b long"), "may-share")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) of classes with whether they link, counted on the whole
    sets of one text each. Texts travel rather than their larger sets, and a
    bit filter keeps the other texts out of the shuffle."""
    sides = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    needed = stored(classes.join(sides, "set").select("set", "doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")), "needed")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    texts = stored(texts.where(row_filter(needed, "h")).join(needed.drop("h"), "doc_id").select("set", "text"), "needed-texts")

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            both = (t.as_py() for pair in zip(batch.column(2), batch.column(3)) for t in pair)
            sets = (s for part in shingle_sets(both, words) for s in part)
            ok = []
            for x, y in zip(sets, sets):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, "bool")], names=["a", "b", "linked"])

    both = (pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("set").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))
    out = stored(both.mapInArrow(count, "a long, b long, linked boolean").distinct(), "verified")
    discard(needed, texts)
    release(docs.sparkSession)
    return out


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Sizes fit, and the rest behind the shared shingle is long enough (it
    holds for the first shingle that linked sets share)."""
    na, nb, least = F.col(f"{a}.n"), F.col(f"{b}.n"), _shared_least(F.col(f"{a}.n"), F.col(f"{b}.n"), num, den)
    return ((F.least(na, nb) * den >= F.greatest(na, nb) * num)
            & (F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) >= least))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def class_roots(docs: DataFrame, classes: DataFrame, scanned: DataFrame, words: int, num: int, den: int,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, root: the components of the linked classes."""
    sizes = classes.where(F.col("n") <= 2 * LARGEST_SMALL).groupBy("n").count().collect()
    boundary = boundary_by_cost({r["n"]: r["count"] for r in sizes}, num, den)
    entries = stored(_entries(docs, _rarity(scanned), boundary, words, num, den, id_col, text_col), "entries")
    # only keys that stand in several entries are shuffled with them
    often = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(often, KEY_FILTER_BITS))
    release(docs.sparkSession)

    def repeated(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view("uint64")
            yield batch.filter(pa.array(in_filter(shared.value, keys)))

    repeats = stored(entries.mapInArrow(repeated, entries.schema).distinct(), "shared-entries")
    discard(entries)
    release(docs.sparkSession)
    groups = repeats.groupBy("key", "c").agg(F.min("set").alias("s0"), F.max("set").alias("s1")).where("s0 != s1").select("key", "c")
    members = stored(repeats.join(groups, ["key", "c"]), "members")
    discard(repeats)
    release(docs.sparkSession)

    # small sets: sharing a subset of size c is enough where c is
    subsets = members.where("c > 0")
    smallest = subsets.groupBy("key", "c").agg(F.min(F.struct("n", "set")).alias("hub"))
    small = stored(subsets.join(smallest, ["key", "c"]).where((F.col("set") != F.col("hub.set")) & (F.col("c") >= _shared_least(F.col("n"), F.col("hub.n"), num, den)))
                   .select(*_ordered("set", "hub.set")).distinct(), "small")

    # large sets: a list proposes its members against one or two hubs in each band of sizes
    lists = members.where("c = 0").select("key", "set", "n", "pos")
    lists = lists.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)))
    lists = stored(lists, "lists")
    discard(members)
    release(docs.sparkSession)
    by_place, by_chance = F.struct("pos", "n", "set"), F.struct(F.xxhash64("key", "set").alias("chance"), "pos", "n", "set")
    hubs = lists.groupBy("key", "band").agg(F.min(by_place).alias("central"), F.min(by_chance).alias("random"), F.count(F.lit(1)).alias("many"))
    of_list = F.when(F.col("many") < MANY, F.array("central")).otherwise(F.array("central", F.struct("random.pos", "random.n", "random.set")))
    proposed = lists.alias("m").join(hubs, ["key", "band"]).select("m.*", F.explode(of_list).alias("h")).alias("m")
    stars = proposed.select(F.struct("set", "n", "pos").alias("x"), F.col("h").alias("y")).where("x.set != y.set").where(_may_link("x", "y", num, den))
    stars = stored(stars.select(*_ordered("x.set", "y.set")).distinct(), "stars")
    verified = _verified(docs, classes, _may_share(classes, stars, num, den), words, num, den, id_col, text_col)
    links = verified.where("linked").select("a", "b").unionByName(small)
    roots = connected_components(links)

    # then members of a list that lie in different components
    placed = lists.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    placed = stored(placed, "placed")
    discard(lists)
    main = placed.groupBy("key").agg(F.min(F.struct("pos", "n", "set", "root")).alias("h"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    mixed = main.where("r0 != r1").select("key", F.col("h.root").alias("main"))
    unjoined = stored(placed.join(mixed, "key"), "mixed")
    discard(placed)
    across = (unjoined.where("root != main").alias("x").join(unjoined.alias("y"), "key")
              .where((F.col("x.root") != F.col("y.root")) & _may_link("x", "y", num, den)).select(*_ordered("x.set", "y.set")).distinct())
    across = stored(across.join(stars.select("a", "b"), ["a", "b"], "left_anti"), "across")
    discard(unjoined)
    release(docs.sparkSession)
    more = _verified(docs, classes, _may_share(classes, across, num, den), words, num, den, id_col, text_col).where("linked").select("a", "b")
    return connected_components(links.unionByName(more))


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row: documents link at a
    Jaccard similarity of ``num / den`` and more of their sets of shingles."""
    scanned = stored(_sets(docs, words, id_col, text_col), "sets")
    rows = scanned.where(F.col("chunk").isNull()).select("doc_id", "n", "set", "bits")
    usable = rows.where(F.col("set").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(usable.groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    roots = class_roots(docs, classes, scanned, words, num, den, id_col, text_col)
    of_class = classes.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    smallest = of_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = stored(of_class.join(smallest, "root").select("set", "component_id"), "class-components")
    alone = rows.where(F.col("set").isNull() | F.col("doc_id").isNull()).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = usable.join(of_class, "set").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return linked.unionByName(alone)
