"""Approximate nearest neighbours by cosine: an inverted multi-index.

Vectors of length one are cut in two halves, and each half is quantised by its
own k-means codebook, learnt on a bounded sample. A pair of centroids is a cell
of the index; every row lies in one. A query sorts each half's centroids by
distance and walks the pairs in order of their summed distance with a heap,
until the cells it has met hold ``reach`` vectors. Their entries are compared
with the query by the cosine of the original vectors.

``reach`` is calibrated: for some queries (at most CALIBRATION) the true nearest
vectors among all rows are found, and the walk must meet RECALL of them.

Cells are laid out in shelves of about SHELF_ROWS entries by a prefix sum over
the cell sizes (one number per pair of centroids, at most CENTROIDS^2); a larger
cell is cut by a hash of its vectors into parts of that size. A group of the
search is one shelf (or part) with at most about QUERIES_PER_GROUP of the
queries that reach it. Equal vectors are one entry with the smallest ids of its
rows: a query returns at most k of them and its own, so k + 1 are enough.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
entries take no part, nor do rows without id; vectors of different dimension
don't meet (each dimension has its own index); all rows with the query's id are
its own; repeated rows count once, and of an id with several vectors the nearest
one counts; ties go to the smaller id; with at most k other vectors all are
found; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import ship_package, stored

K = 5
SAMPLE_VALUES = 1 << 20  # numbers that the codebooks are learnt from, at most: 16,384 vectors of 64 entries
CENTROIDS = 256          # of a codebook, at most
ROWS_PER_CELL = 16       # wanted, while the codebooks can grow
ROUNDS = 12              # of k-means
CALIBRATION = 256        # queries whose true neighbours set ``reach``, at most
RECALL = 0.96            # wanted of those
LEAST_REACH = 256        # vectors that a walk meets at least (if there are so many)
SHELF_ROWS = 4096
QUERIES_PER_GROUP = 1024

_FOUND = "query_id long, vec_id long, score double"


class MultiIndex(NamedTuple):
    """Codebooks of the two halves, and the layout of the cells."""
    first: np.ndarray            # centroids x entries of the first half
    second: np.ndarray
    sizes: np.ndarray | None = None    # entries per cell, cell = first centroid * centroids + second
    reach: int = 0
    shelf_rows: int = SHELF_ROWS

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return unit[:, :cut], unit[:, cut:]

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to their centroids."""
        return tuple(_distances(x, book) for x, book in zip(self.halves(unit), (self.first, self.second)))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def walk(self, first: np.ndarray, second: np.ndarray) -> Iterator[int]:
        """Cells with entries in order of summed distance: each pair (i, j) of
        the sorted lists is pushed when its neighbours before it are popped."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        x, y, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
        next_of = [0] * len(x)  # per row i, the columns below have been popped
        heap, sizes, width = [(x[0] + y[0], 0, 0)], self.sizes, len(y)
        while heap:
            _, i, j = heapq.heappop(heap)
            next_of[i] = j + 1
            cell = a[i] * width + b[j]
            if sizes[cell]:
                yield cell
            if i + 1 < len(x) and next_of[i + 1] == j:
                heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
            if j + 1 < width and (i == 0 or next_of[i - 1] > j + 1):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))

    def shelves(self) -> tuple[np.ndarray, np.ndarray]:
        """Shelf and number of parts of every cell."""
        before = np.cumsum(self.sizes) - self.sizes
        large = self.sizes > self.shelf_rows
        # a large cell has a shelf of its own; the others share one by their place
        own = np.arange(len(self.sizes)) + len(self.sizes) + before[-1]
        return np.where(large, own, before // self.shelf_rows), np.maximum(1, -(-self.sizes // self.shelf_rows))


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2.0 * (x @ book.T) + (book**2).sum(axis=1)


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from the farthest of random points; empty centroids stay."""
    random = np.random.default_rng(7)
    book = x[random.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        nearest = _distances(x, book).argmin(axis=1)
        count = np.bincount(nearest, minlength=k)
        total = np.zeros_like(book)
        np.add.at(total, nearest, x)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; exact, and without effect on a cosine."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / _norms(v)[:, None]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _entries(rows: DataFrame, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Usable rows (vec_id, v), and the distinct vectors with the k + 1 smallest
    ids of their rows. The window's limit works in each task before the shuffle,
    so copies of one vector reach it as at most k + 1 rows a task."""
    v = F.col(vector_col).cast("array<double>")
    usable = rows.where(_usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    same = Window.partitionBy("h", "v").orderBy("vec_id")
    few = usable.distinct().withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    ids = F.sort_array(F.collect_list("vec_id"))
    return usable, few.groupBy("h", "v").agg(ids.alias("ids")).select("h", "ids", "v", F.size("v").alias("dim"))


def _about(rows: DataFrame, n: int, wanted: int, hashed: Column) -> list:
    """At most ``wanted`` of ``n`` rows, those of small hash: nearly all, if there
    are not more. The hash thins the rows out in their tasks."""
    share = min(1.0, wanted / max(n, 1))
    return rows.where(hashed <= F.lit((share - 0.5) * 2.0**64)).limit(wanted).collect()


def _learn(entries: DataFrame, n: int, dim: int) -> MultiIndex:
    """Codebooks from at most SAMPLE_VALUES / dim distinct vectors, those of small hash."""
    sample = sorted(_about(entries.select("h", "v"), n, max(CENTROIDS, SAMPLE_VALUES // dim), F.col("h")))
    unit = _unit(np.array([r["v"] for r in sample] or [[1.0] * dim], float))
    k = max(1, min(CENTROIDS, len(unit), round((n / ROWS_PER_CELL) ** 0.5)))
    cut = dim // 2
    return MultiIndex(*(_kmeans(x, k) for x in (unit[:, :cut], unit[:, cut:])))


def _cosines(v: np.ndarray, norms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the scaled rows with a scaled query, summed in one order wherever a row stands."""
    return (v * q).sum(axis=1) / (norms * np.sqrt((q * q).sum()))


def _best(query: int, q: np.ndarray, v: np.ndarray, norms: np.ndarray, ids: list, rough: np.ndarray, k: int) -> list:
    """The ``k`` best ids other than the query's; ties by id. Exact cosines are
    taken of the entries whose ``rough`` ones can be among the best; more of
    them, if ids repeat."""
    take = 2 * (k + 1)
    while True:
        few = take < len(rough)
        some = np.flatnonzero(rough >= np.partition(rough, len(rough) - take)[len(rough) - take] - 1e-9) if few else np.arange(len(rough))
        found: dict[int, float] = {}
        for e, s in zip(some.tolist(), _cosines(v[some], norms[some], q).tolist()):
            for i in ids[e]:
                if i != query and found.get(i, -2.0) < s:
                    found[i] = s
        if len(found) >= k or not few:
            return [(query, i, s) for i, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]]
        take *= 4


def _as_rows(found: list[tuple]) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    return pa.Table.from_pydict({name: [r[i] for r in found] for i, name in enumerate(schema.names)}, schema=schema)


def _true_cells(index: DataFrame, queries: DataFrame, model: MultiIndex, k: int, dim: int) -> list:
    """(query vector, cells of its true k nearest entries) of a bounded number of queries."""
    some = [(r["query_id"], r["v"]) for r in _about(queries, queries.count(), CALIBRATION, F.xxhash64("query_id"))]
    spark = index.sparkSession
    if not some:
        return []
    shared = spark.sparkContext.broadcast(([i for i, _ in some], _unit(np.array([v for _, v in some], float))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, unit = shared.value
        best: list[list] = [[] for _ in numbers]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            cells = batch.column(batch.schema.get_field_index("cell")).to_numpy(zero_copy_only=False)
            scores = unit @ _unit(_matrix(batch.column(batch.schema.get_field_index("v")), dim)).T
            some = min(k + 1, scores.shape[1])
            top = np.argpartition(scores, scores.shape[1] - some, axis=1)[:, -some:]
            for n, query in enumerate(numbers):
                best[n] += [(float(scores[n, e]), int(cells[e])) for e in top[n] if ids[e] != [query]]
                best[n] = sorted(best[n], reverse=True)[:k]
        flat = [(n, s, c) for n, b in enumerate(best) for s, c in b]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat), ("int32", "float64", "int64"))], names=["n", "score", "cell"])

    found = index.mapInArrow(near, "n int, score double, cell long")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy(F.col("score").desc(), "cell"))).where(F.col("r") <= k)
    cells: list[list[int]] = [[] for _ in some]
    for r in found.collect():  # at most CALIBRATION * k
        cells[r["n"]].append(r["cell"])
    return list(zip(shared.value[1], cells))


def _reach(model: MultiIndex, truth: list, recall: float) -> int:
    """Vectors that a walk must meet so that ``recall`` of the true neighbours are among them."""
    needed = []
    for unit, wanted in truth:
        first, second = (d[0] for d in model.distances(unit[None]))
        met, left = 0, list(wanted)
        for cell in model.walk(first, second):
            met += int(model.sizes[cell])
            while cell in left:
                left.remove(cell)
                needed.append(met)
            if not left:
                break
    needed.sort()
    enough = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 0
    return max(LEAST_REACH, enough)


def build(entries: DataFrame, queries: DataFrame, n: int, dim: int, k: int, recall: float) -> tuple[DataFrame, MultiIndex]:
    """Every entry with its cell (a written table), and the calibrated index."""
    spark = entries.sparkSession
    model = _learn(entries, n, dim)
    books = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(batch.schema.get_field_index("v")), dim))
                yield pa.RecordBatch.from_arrays([pa.array(books.value.cells(unit), "int64"), *batch.columns], names=["cell", *batch.schema.names])

    placed = entries.select("h", "ids", "v").mapInArrow(place, "cell long, h long, ids array<long>, v array<double>")
    index = stored(placed, "multi-index")
    sizes = np.zeros(len(model.first) * len(model.second), "int64")
    for r in index.groupBy("cell").count().collect():  # at most one row per pair of centroids
        sizes[r["cell"]] = r["count"]
    model = model._replace(sizes=sizes)
    return index, model._replace(reach=_reach(model, _true_cells(index, queries, model, k, dim), recall))


def _routes(queries: DataFrame, model: MultiIndex, dim: int) -> DataFrame:
    """One row per query and shelf part that its walk meets, with the cells it wants there."""
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        shelf, parts = (x.tolist() for x in index.shelves())
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = index.distances(_unit(_matrix(batch.column(batch.schema.get_field_index("v")), dim)))
            for q, query in enumerate(batch.column(batch.schema.get_field_index("query_id")).to_pylist()):
                met, wanted = 0, {}
                for cell in index.walk(first[q], second[q]):
                    met += int(index.sizes[cell])
                    for part in range(parts[cell]):
                        wanted.setdefault((shelf[cell], part), []).append(cell)
                    if met >= index.reach:
                        break
                keys = list(wanted)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array([query] * len(keys), "int64"), "shelf": pa.array([s for s, _ in keys], "int64"),
                    "part": pa.array([p for _, p in keys], "int32"), "cells": pa.array(list(wanted.values()), pa.list_(pa.int64())),
                    "v": batch.column(batch.schema.get_field_index("v")).take(pa.array([q] * len(keys)))})

    return queries.mapInArrow(route, "query_id long, shelf long, part int, cells array<long>, v array<double>")


def _search(index: DataFrame, queries: DataFrame, model: MultiIndex, k: int, dim: int, group: int) -> DataFrame:
    """query_id, vec_id and score: of every group the best k of each query."""
    spark = index.sparkSession
    shelf, parts = model.shelves()
    layout = spark.sparkContext.broadcast((shelf, parts))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf_of, parts_of = layout.value
        for batch in batches:
            cell = batch.column(batch.schema.get_field_index("cell")).to_numpy(zero_copy_only=False)
            h = batch.column(batch.schema.get_field_index("h")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(shelf_of[cell], "int64"), pa.array(h % parts_of[cell], "int32"), *batch.columns],
                                             names=["shelf", "part", *batch.schema.names])

    routes = stored(_routes(queries, model, dim), "routes")
    # queries of a part that many reach are dealt over several groups, each with a copy of the part
    groups = routes.groupBy("shelf", "part").agg(F.count(F.lit(1)).alias("n")).select("shelf", "part", F.ceil(F.col("n") / group).cast("int").alias("groups"))
    left = routes.join(groups, ["shelf", "part"]).withColumn("deal", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).drop("groups")
    right = (index.mapInArrow(lay, "shelf long, part int, cell long, h long, ids array<long>, v array<double>")
             .join(groups, ["shelf", "part"]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups", "h"))

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return _as_rows([])
        v = _scaled(_matrix(held["v"], dim))
        norms, ids, cells = _norms(v), held["ids"].to_pylist(), held["cell"].to_numpy()
        only = np.array([i[0] if len(i) == 1 else None for i in ids], object)  # the id of an entry with one
        names, place = np.unique(cells, return_inverse=True)
        unit = v / norms[:, None]
        found = []
        for query, wanted, q in zip(asked["query_id"].to_pylist(), asked["cells"].to_pylist(), _scaled(_matrix(asked["v"], dim))):
            some = np.flatnonzero(np.isin(names, wanted)[place] & (only != query))
            if len(some):
                rough = unit[some] @ (q / np.sqrt((q * q).sum()))
                found += _best(query, q, v[some], norms[some], [ids[e] for e in some.tolist()], rough, k)
        return _as_rows(found)

    key = ["shelf", "part", "deal"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, _FOUND)


def nearest(rows: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, id_col: str = "vec_id",
            vector_col: str = "embedding", shelf_rows: int = SHELF_ROWS, queries_per_group: int = QUERIES_PER_GROUP) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of every row
    for which ``is_query`` (an expression of ``vec_id``) holds."""
    spark = rows.sparkSession
    ship_package(spark)
    usable, entries = _entries(rows, k, id_col, vector_col)
    entries = stored(entries, "entries")
    asked = stored(usable.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct(), "queries")
    found = spark.createDataFrame([], _FOUND)
    for r in entries.groupBy("dim").count().orderBy("dim").collect():
        dim = r["dim"]
        queries = asked.where(F.size("v") == dim)
        if not queries.isEmpty():
            index, model = build(entries.where(F.col("dim") == dim), queries, r["count"], dim, k, recall)
            found = found.unionByName(_search(index, queries, model._replace(shelf_rows=shelf_rows), k, dim, queries_per_group))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
