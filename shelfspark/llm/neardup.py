"""Embedding near-duplicates by collision-counting projections.

Vectors (of one label and dimension) are projected on many random directions.
Around each query's value a window is opened on every direction; two vectors
at the cosine limit collide in a window with known probability, and a pair is
verified when it collides on at least ``m - (GROUPS - 1)`` of the m directions,
the count that keeps ``RECALL`` of the pairs at the limit (closer pairs are
kept more often). A pair that passes misses fewer windows than there are groups
of directions, so in some group it misses none: each group of directions is a
grid, a vector is data in its own cell and a query in the cells its windows
reach, and cells are sorted by one projection and scanned by window. The pair
is counted in the first such group only. Large cells are cut into blocks of
data and of queries. Equal vectors are one representative with a number of
copies; links are counted and joined inside the tasks, never emitted pair-wise.

Defined cases: rows whose label is null, or whose vector is null, empty, zero
or holds null or non-finite components, link with nothing; so do vectors of
other dimensions; rows with equal ids are one vector of the smallest contents;
rows with a null id are left out; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import stored
from shelfspark.llm.components import connected_components

GROUPS = 3
RECALL = 0.995
CELL = 3.0  # width of a grid cell, in window half widths
BLOCK_ROWS = 2048
COMPARE_S, ROW_S = 3e-9, 1e-6  # what a comparison and a copied row cost, for the number of directions


def per_group(n: int) -> int:
    """Directions of a group: more as a label grows, where fewer comparisons
    pay for more copies of its queries."""
    return max(3, round(math.log(max(n, 1) * COMPARE_S / ROW_S + 1, 2.5 * (1 + 2 / CELL))))


def half_width(m: int, cosine: float, recall: float = RECALL) -> float:
    """Half width of the windows at which a pair at the limit collides on all
    but GROUPS - 1 of ``m`` directions with probability ``recall``."""
    spread = math.sqrt(2 - 2 * cosine)  # of the projections' difference

    def kept(z: float) -> float:
        q = math.erf(z / math.sqrt(2))
        return sum(math.comb(m, i) * q ** (m - i) * (1 - q) ** i for i in range(GROUPS))

    low, high = 0.0, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if kept(mid) < recall else (low, mid)
    return max(high * spread, 1e-6)


def _directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng([dim, m]).standard_normal((dim, m))


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _placed(reps: DataFrame, g: int, width: float, data_only: bool) -> DataFrame:
    """Rows (cell, is_query, rep, copies, dims, p, v): a representative in its cell
    as data, and in all cells that its windows reach as query."""
    m = g * GROUPS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            values, ends = batch.column(3).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            p = np.empty((batch.num_rows, m))
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                p[at] = _units(np.stack([values[ends[i]:ends[i + 1]] for i in at]).astype("float64")) @ _directions(dim, m)
            own = batch.column(2).to_numpy(zero_copy_only=False).astype("uint64") * np.uint64(1 << 32) + sizes.astype("uint64")
            rows, cells, asks = [], [], []
            low, high = np.floor((p - width) / (CELL * width)).astype("int64"), np.floor((p + width) / (CELL * width)).astype("int64")
            home = np.floor(p / (CELL * width)).astype("int64")

            def add(which: np.ndarray, group: int, corner: np.ndarray, ask: bool) -> None:
                key = own[which] ^ np.uint64(group * 0x9E3779B97F4A7C15 % 2**64)
                for j in range(g):
                    key = (key ^ corner[:, j].astype("uint64")) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(29)
                rows.append(which)
                cells.append(key.view("int64"))
                asks.append(np.full(len(which), ask))

            everyone = np.arange(batch.num_rows)
            for group in range(GROUPS):
                cols = slice(group * g, group * g + g)
                add(everyone, group, home[:, cols], False)
                for side in range(0 if data_only else 1 << g):
                    up = np.array([side >> j & 1 for j in range(g)], bool)
                    differs = (low[:, cols] < high[:, cols])[:, up].all(axis=1)
                    which = np.flatnonzero(differs)
                    add(which, group, np.where(up, high[which, cols], low[which, cols]), True)
            at = pa.array(np.concatenate(rows))
            group_of = np.concatenate([np.full(len(r), c // (1 if data_only else 1 + (1 << g)), "int32") for c, r in enumerate(rows)])
            out = {"cell": pa.array(np.concatenate(cells)), "is_query": pa.array(np.concatenate(asks)), "grid": pa.array(group_of)}
            if not data_only:
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * m + 1, m, dtype="int32")), pa.array(p.ravel()))
                out |= {"rep": batch.column(0).take(at), "copies": batch.column(1).take(at), "label": batch.column(2).take(at),
                        "p": listed.take(at), "v": batch.column(3).take(at)}
            yield pa.RecordBatch.from_pydict(out)

    schema = "cell long, is_query boolean, grid int" + ", rep long, copies long, label long, p array<double>, v array<double>" * (not data_only)
    return reps.select("rep", "copies", "label", "v").mapInArrow(place, schema)


def _linker(g: int, width: float, cosine: float):
    m = g * GROUPS

    def link(table: pa.Table) -> pa.Table:
        """Links counted for the queries of one block, and one root for every
        group of vectors that the block's links join."""
        rep, copies, label = (table[c].to_numpy() for c in ("rep", "copies", "label"))
        ask, grid = table["is_query"].to_numpy(), table["grid"].to_numpy()
        lengths = table["v"].combine_chunks().value_lengths().to_numpy()
        p = table["p"].combine_chunks().flatten().to_numpy().reshape(-1, m)
        links, parent = {}, {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        flat, ends = table["v"].combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])
        for kind in {*zip(label.tolist(), lengths.tolist(), grid.tolist())}:  # one, unless cell keys collide
            same = (label == kind[0]) & (lengths == kind[1]) & (grid == kind[2])
            data, queries, first = np.flatnonzero(same & ~ask), np.flatnonzero(same & ask), kind[2] * g
            if not len(data) or not len(queries):
                continue
            data = data[np.argsort(p[data, first], kind="stable")]
            line = p[data, first]
            units = _units(np.stack([flat[ends[i]:ends[i] + kind[1]] for i in data]).astype("float64"))
            asking = _units(np.stack([flat[ends[i]:ends[i] + kind[1]] for i in queries]).astype("float64"))
            start, end = np.searchsorted(line, p[queries, first] - width, "left"), np.searchsorted(line, p[queries, first] + width, "right")
            for k, q in enumerate(queries.tolist()):
                a, b = int(start[k]), int(end[k])
                if a == b:
                    continue
                found = np.arange(a, b)
                for j in range(first + 1, first + g):
                    found = found[np.abs(p[data[found], j] - p[q, j]) <= width]
                if not len(found):
                    continue
                hit = np.abs(p[data[found]] - p[q]) <= width
                whole = hit.reshape(-1, GROUPS, g).all(axis=2)
                ok = (hit.sum(axis=1) >= m - (GROUPS - 1)) & (whole.argmax(axis=1) == kind[2]) & (rep[data[found]] != rep[q])
                found = found[ok]
                found = found[units[found] @ asking[k] >= cosine]
                if not len(found):
                    continue
                links[int(rep[q])] = links.get(int(rep[q]), 0) + int(copies[data[found]].sum())
                mine = root(int(rep[q]))
                for other in rep[data[found]].tolist():
                    theirs = root(other)
                    if theirs != mine:
                        low, high = min(mine, theirs), max(mine, theirs)
                        parent[high], mine = low, low
        nodes = sorted(parent)
        return pa.table({"rep": pa.array(nodes, "int64"), "n": pa.array([links.get(x, 0) for x in nodes], "int64"),
                         "root": pa.array([root(x) for x in nodes], "int64")})

    return link


def near_duplicates(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.coalesce(F.col(label_col).isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda c: c != 0), F.lit(False))
    one = F.min(F.struct(F.when(usable, F.xxhash64(F.col(label_col).cast("string"))).alias("label"), F.when(usable, x).alias("v")))
    vectors = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(one.alias("x")).select("vec_id", "x.*")
    vectors = stored(vectors, "vectors")
    usable_rows = vectors.where(F.col("v").isNotNull())
    reps = stored(usable_rows.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    g = per_group(largest)
    width = half_width(g * GROUPS, cosine)

    sizes = _placed(reps, g, width, True).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS)
    large = stored(sizes.select("cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts")), "large-cells")
    parts = F.coalesce("parts", F.lit(1))
    every = F.sequence(F.lit(0), parts - 1)
    mine = F.array(F.pmod(F.xxhash64("rep"), parts).cast("int"))
    placed = (_placed(reps, g, width, False).join(large, "cell", "left")
              .withColumn("q_block", F.explode(F.when(F.col("is_query"), mine).otherwise(every)))
              .withColumn("d_block", F.explode(F.when(F.col("is_query"), every).otherwise(mine))).drop("parts"))
    found = placed.groupBy("cell", "q_block", "d_block").applyInArrow(_linker(g, width, cosine), "rep long, n long, root long")
    found = stored(found, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    per_rep = (reps.join(counts, "rep", "left").join(roots, "rep", "left")
               .select("label", "v", F.coalesce("n", F.lit(0)).alias("n"), "copies", F.coalesce("root", "rep").alias("component_id")))
    linked = usable_rows.join(per_rep, ["label", "v"]).select("vec_id", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = vectors.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
