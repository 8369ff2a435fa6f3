"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are sorted by length into buckets of bounded size, queries into blocks.
The bucket of the longest vectors gives every query a first k-th score. In any
other bucket that score is a local cosine threshold, score / (|q| longest): above
1 the bucket is skipped; otherwise the query takes, whichever leaves fewer
vectors, the length bound (a prefix of the bucket) or the feasible interval of
its largest coordinate (a slice of the bucket sorted by it). What is left is
verified by whole integer products. Blocks meet buckets in groups of bounded
size, so no task holds a whole table.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part; nor do rows with a null id; vectors of different
dimension don't meet; all rows with the query's id are its own rows; equal
rows count once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import stored

SCALE = 64
BUCKET_ROWS = 4096
BLOCK_ROWS = 512
BLOCKS_PER_GROUP = 8
SLACK = 1e-9  # of the bounds, for rounding

_BLOB = "no long, dim int, longest double, least double, ids binary, floors binary, vectors binary"


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def integer_vectors(rows: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim, norm and v, the floors of the scaled components (whole numbers as doubles)."""
    x = F.col(vector_col).cast("array<double>")
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double"))
    ok = rows.where(_usable(x) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    return ok.select("vec_id", F.size("v").alias("dim"), norm.alias("norm"), "v")


def _blobs(rows: DataFrame, size: int) -> DataFrame:
    """Vectors (with the score that each must reach, ``floor``) in order of
    dimension and falling length, packed into numbered blobs of at most
    ``size`` rows."""
    parts = max(1, -(-rows.count() // size))
    order = ["dim", F.col("norm").desc(), "vec_id"]
    ordered = rows.select("vec_id", "dim", "norm", "floor", "v").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def blob() -> pa.RecordBatch:
            nonlocal number
            dim, ids, norms, floors, values = held.pop(0)
            number += 1
            return pa.RecordBatch.from_pydict({
                "no": [number - 1], "dim": pa.array([dim], "int32"), "longest": [float(norms.max())], "least": [float(floors.min())],
                "ids": [ids.tobytes()], "floors": [floors.tobytes()], "vectors": [values.tobytes()]})

        for batch in batches:
            ids, dims, norms, floors = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            values, ends = batch.column(4).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(ids)]
            for x, y in zip(cuts, cuts[1:]):
                for a in range(x, y, size):
                    b = min(a + size, y)
                    new = (int(dims[a]), ids[a:b], norms[a:b], floors[a:b], values[ends[a]:ends[b]])
                    if held and held[-1][0] == new[0] and len(held[-1][1]) + b - a <= size:
                        new = (new[0], *(np.concatenate(z) for z in zip(held.pop()[1:], new[1:])))
                    held.append(new)
            while len(held) > 1:
                yield blob()
        while held:
            yield blob()

    return stored(ordered.mapInArrow(pack, _BLOB), "vector-blobs")


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "int64"), np.frombuffer(row["vectors"], "float64").reshape(-1, row["dim"])


def _products(queries: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles carry them below 2**53, else long integers."""
    bound = np.abs(queries).max(initial=0) * np.abs(found).max(initial=0) * queries.shape[-1]
    if bound < 2**53:
        return (found @ queries).astype("int64")
    return found.astype("int64") @ queries.astype("int64")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best, equal (id, score) once: copies must not fill the places of others."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    return ids[new][:k], scores[new][:k]


def _search(query_rows: list[dict], bucket: dict, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, vector, score) of the at most k best of a bucket that reach the query's threshold."""
    ids, vectors = _matrix(bucket)
    norms = np.sqrt((vectors**2).sum(axis=1))  # falling
    unit = vectors / np.maximum(norms, 1e-300)[:, None]
    by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for block in query_rows:
        q_ids, q_vectors = _matrix(block)
        for q_id, q, floor in zip(q_ids.tolist(), q_vectors, np.frombuffer(block["floors"], "float64").tolist()):
            length = float(np.sqrt((q**2).sum()))
            longest = norms[0] * length
            kept = slice(None)
            if floor > 0:
                cosine = floor / max(longest, 1e-300)
                if cosine > 1 + SLACK:
                    continue
                prefix = int(np.searchsorted(-norms, -floor / length * (1 - SLACK), side="right"))
                kept = slice(0, prefix)
                t = min(cosine, 1.0)
                f = int(np.abs(q).argmax())
                x = q[f] / length
                reach = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + SLACK
                if f not in by_coordinate:
                    order = np.argsort(unit[:, f], kind="stable")
                    by_coordinate[f] = order, unit[order, f]
                order, values = by_coordinate[f]
                low = -np.inf if -x >= t else x * t - reach
                high = np.inf if x >= t else x * t + reach
                a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
                if b - a < prefix:
                    kept = order[a:b]
            found, scores = ids[kept], _products(q, vectors[kept])
            ok = (found != q_id) & (scores >= floor)
            for v, s in zip(*(x.tolist() for x in _best(found[ok], scores[ok], k))):
                yield q_id, v, s


def _pairs(blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of every block of queries against every
    bucket of its dimension that can still hold a better vector. A group is one
    bucket with a few blocks."""

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [x for bucket in right.to_pylist() for x in _search(left.to_pylist(), bucket, k)]
        return pa.Table.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema=schema)

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    numbers = buckets.select(F.col("no").alias("bucket"), F.col("dim").alias("b_dim"), F.col("longest").alias("b_longest"))
    blocks = blocks.withColumn("part", F.floor(F.shiftright("no", 32) / BLOCKS_PER_GROUP))
    # pairs of numbers first: vectors move only where they may matter
    meets = stored(blocks.select("no", "dim", "longest", "least", "part").join(numbers, F.col("dim") == F.col("b_dim"))
             .where(F.col("longest") * F.col("b_longest") * (1 + SLACK) >= F.col("least")).select("no", "part", "bucket"), "meets")
    left = blocks.drop("part").join(meets, "no").drop("no")
    groups = meets.select(F.col("bucket").alias("no"), F.col("part").alias("of_part")).distinct()
    right = groups.join(buckets, "no")
    return (left.groupBy("bucket", "part").cogroup(right.groupBy("no", "of_part"))
            .applyInArrow(search, "query_id long, vec_id long, score long"))


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best products of every row
    for which ``is_query`` (an expression of ``vec_id``) holds."""
    vectors = stored(integer_vectors(rows, scale, id_col, vector_col), "vectors")
    buckets = _blobs(vectors.withColumn("floor", F.lit(float("-inf"))), BUCKET_ROWS)
    queries = vectors.where(is_query)
    first = buckets.groupBy(F.col("dim").alias("d")).agg(F.min("no").alias("n"))
    is_first = (F.col("dim") == F.col("d")) & (F.col("no") == F.col("n"))

    seeds = _pairs(_blobs(queries.withColumn("floor", F.lit(float("-inf"))), BLOCK_ROWS),
                   buckets.join(first, is_first, "left_semi"), k)
    seeds = stored(seeds, "seeds")
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = (seeds.distinct().withColumn("r", F.row_number().over(by_query)).where(F.col("r") == k)
           .select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor")))
    floored = queries.join(kth, "vec_id", "left").fillna(float("-inf"), "floor")
    rest = _pairs(_blobs(floored, BLOCK_ROWS), buckets.join(first, is_first, "left_anti"), k)
    found = seeds.unionByName(rest).distinct()
    return (found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
