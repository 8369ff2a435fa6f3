"""Tables with gap-free row numbers that are not stored.

A numbered folder (a part) keeps its rows in order: each row has its place
within the part in ``_row``, and ``_part`` names the part. A commit lists a
table's parts in order with their row counts, so the number of a row is the sum
of the rows of the parts before it, plus its place. Parts are written once; to
append, remove or replace a part changes the numbers of all later rows without
touching them, and two appends can't claim the same numbers.

Two layouts. A *split* part is written as it comes: ``_row`` holds task and
position within the task, and ``_offsets`` the rows of the tasks before. A *slice*
holds at most SLICE_ROWS rows whose places are known when it is written; tables
that are updated in places are kept in slices, aligned with those of the tables
made from them.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators.commits import Snapshot

SLICE_ROWS = 1_000_000
MAX_SLICES = 4_096          # of a table, so that a commit stays small; larger tables get larger slices
MAX_PARTITIONS = 100_000    # of a split part: bounds the table of offsets that is broadcast
PARTITION_BYTES = 128 << 20
TASK_BITS = 33              # of _row: position within the task, as in monotonically_increasing_id


def input_bytes(df: DataFrame) -> int:
    """Size of the files and local rows that a plan reads, as Spark knows it (what it doesn't know counts as nothing)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def partitions_for(df: DataFrame) -> int:
    """Partitions to sort ``df`` in: by the size of its input, at least the session's number."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_PARTITIONS, max(least, -(-input_bytes(df) // PARTITION_BYTES)))


def sort_keys(df: DataFrame, order: list) -> list[Column]:
    """Columns that sort like ``order`` (names or expressions): a named struct by its fields,
    which Spark compares faster one by one."""
    def fields(c: Column, kind: T.DataType, nullable: bool) -> list[Column]:
        if not isinstance(kind, T.StructType):
            return [c]
        inner = [k for f in kind.fields for k in fields(c.getField(f.name), f.dataType, f.nullable)]
        return [c.isNotNull(), *inner] if nullable else inner

    return [k for o in order for k in (fields(F.col(f"`{o}`"), df.schema[o].dataType, df.schema[o].nullable) if isinstance(o, str) else [o])]


def write_split(df: DataFrame, path: str, order: list | None = None, partitions: int | None = None, row_group_bytes: int | None = None, cells=None) -> dict:
    """Write ``df`` once as a split part, in ``order`` (None: as its partitions
    come, file order for a scan), and its offsets. Rows that tie on ``order``
    are told apart by their scan position, so that a value of many rows spreads
    over several partitions. ``cells`` makes the written columns of the sorted
    rows, so that only what it reads is shuffled. Returns the part's entry of the commit."""
    spark = df.sparkSession
    name = uuid.uuid4().hex
    rows = df
    if order:
        tied = df.withColumn("_tie", F.monotonically_increasing_id())
        keys = [*sort_keys(df, order), F.col("_tie")]
        rows = tied.repartitionByRange(partitions or partitions_for(df), *keys).sortWithinPartitions(*keys).drop("_tie")
    rows = cells(rows) if cells else rows
    writer = rows.withColumn("_part", F.lit(name)).withColumn("_row", F.monotonically_increasing_id()).write
    (writer.option("parquet.block.size", str(row_group_bytes)) if row_group_bytes else writer).parquet(path)
    task = F.shiftright("_row", TASK_BITS).cast("int").alias("task")
    counts = sorted((r["task"], r["n"]) for r in spark.read.schema("_row long").parquet(path).groupBy(task).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for number, n in counts:
        offsets.append((number, before))
        before += n
    spark.createDataFrame(offsets, "task int, before long").coalesce(1).write.parquet(os.path.join(path, "_offsets"))
    return {"part": name, "rows": before, "tasks": len(offsets)}


def write_slices(df: DataFrame, base: str, number: str = "_n", slice_rows: int | None = None) -> tuple[list[str], dict[str, dict]]:
    """Write ``df``, whose column ``number`` is dense from 1, as slices in a
    fresh version folder below ``base``. Returns their folders in order, and
    their entries of the commit."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    path = os.path.join(base, f"v-{version}")
    size = slice_rows or SLICE_ROWS
    at = F.col(number) - 1
    placed = df.withColumn("_slice", F.floor(at / size).cast("int")).withColumn("_part", F.concat(F.lit(f"{version}:"), F.col("_slice").cast("string"))) \
        .withColumn("_row", F.pmod(at, F.lit(size)).cast("long")).drop(number)
    return write_parts(placed, path, version)


def write_parts(placed: DataFrame, path: str, version: str) -> tuple[list[str], dict[str, dict]]:
    """Write rows that carry ``_slice``, ``_part`` (``<version>:<slice>``) and
    ``_row``, one folder per slice."""
    spark = placed.sparkSession
    placed.repartition("_slice").sortWithinPartitions("_slice", "_row").write.partitionBy("_slice").parquet(path)
    found = spark.read.schema("_slice int").parquet(path).groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = sorted((r["_slice"], r["n"]) for r in found)
    paths = [os.path.join(path, f"_slice={k}") for k, _ in counts]
    return paths, {p: {"part": f"{version}:{k}", "rows": n} for p, (k, n) in zip(paths, counts)}


def starts(paths: list[str], parts: dict[str, dict], first: int = 1) -> list[tuple[str, int, int]]:
    """(folder, number of its first row, rows) of every part."""
    out = []
    for path in paths:
        out.append((path, first, parts[path]["rows"]))
        first += parts[path]["rows"]
    return out


def read_parts(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """The stored rows with ``_part`` and ``_row``."""
    if schema is None:
        return spark.read.parquet(*paths)
    places = T.StructType([T.StructField("_part", T.StringType()), T.StructField("_row", T.LongType())])
    return spark.read.schema(T.StructType(schema.fields + places.fields)).parquet(*paths)


def with_numbers(rows: DataFrame, paths: list[str], parts: dict[str, dict], id_col: str, first: int = 1) -> DataFrame:
    """``rows`` (of ``read_parts``) with their numbers in ``id_col``."""
    spark = rows.sparkSession
    begin = [(parts[p]["part"], start, "tasks" in parts[p]) for p, start, _ in starts(paths, parts, first)]
    places = spark.createDataFrame(begin, "_part string, _start long, _split boolean")
    task = F.shiftright("_row", TASK_BITS).cast("int")
    split = [p for p in paths if "tasks" in parts[p]]
    if split:
        name = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/_offsets/", 1)
        folder = spark.createDataFrame([(os.path.basename(p), parts[p]["part"]) for p in split], "_folder string, _part string")
        offsets = spark.read.schema("task int, before long").parquet(*[os.path.join(p, "_offsets") for p in split]).withColumn("_folder", name)
        offsets = offsets.join(folder, "_folder").drop("_folder")
        tasks = places.where("_split").join(offsets, "_part").select("_part", "task", (F.col("_start") + F.col("before")).alias("_start"))
        places = tasks.unionByName(places.where("not _split").select("_part", F.lit(0).alias("task"), "_start"))
    else:
        places = places.select("_part", F.lit(0).alias("task"), "_start")
    few = len(begin) + sum(parts[p]["tasks"] for p in split) <= MAX_PARTITIONS
    places = F.broadcast(places) if few else places
    number = (F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << TASK_BITS) - 1))).cast("long").alias(id_col)
    # the task of a slice's rows is 0, their places stay below one task's range
    columns = [F.col(f"`{c}`") for c in rows.columns if c not in ("_part", "_row", id_col)]
    joined = rows.withColumn("task", task) if "task" not in rows.columns else rows.withColumn("_task", task)
    key = "task" if "task" not in rows.columns else "_task"
    return joined.join(places.withColumnRenamed("task", key), ["_part", key]).select(number, *columns)


def _places(spark: SparkSession, path: str, part: dict, low: int, high: int) -> tuple[int, int]:
    """``_row`` of the first and last of some rows of a part (counted from 0)."""
    if "tasks" not in part:
        return low, high
    # one row per task that wrote the part, at most MAX_PARTITIONS
    offsets = [(r["before"], r["task"]) for r in spark.read.schema("task int, before long").parquet(os.path.join(path, "_offsets")).orderBy("before", "task").collect()]
    at = []
    for n in (max(low, 0), min(high, part["rows"] - 1)):
        before, task = max((x for x in offsets if x[0] <= n), default=(0, 0))
        at.append((task << TASK_BITS) + n - before)
    return at[0], at[1]


def read_numbered(spark: SparkSession, state: Snapshot, name: str, id_col: str, schema: T.StructType | None = None,
                  between: tuple[int, int] | None = None) -> DataFrame:
    """A numbered table of a snapshot; with ``between`` only the rows of those
    numbers, read from the parts that hold them."""
    paths, first = state.paths(name), 1
    if between is not None:
        low, high = between
        kept = [(p, s) for p, s, n in starts(paths, state.parts) if s <= high and s + n > low]
        if not kept:
            paths = paths[:1]
        else:
            paths, first = [p for p, _ in kept], kept[0][1]
    stored = T.StructType([f for f in schema.fields if f.name != id_col]) if schema is not None else None
    rows = read_parts(spark, paths, stored)
    if between is not None and len(paths) == 1:
        # a bound on the stored place reaches the scan: files and row groups are pruned
        rows = rows.where(F.col("_row").between(*_places(spark, paths[0], state.parts[paths[0]], low - first, high - first)))
    out = with_numbers(rows, paths, state.parts, id_col, first)
    if between is not None:
        out = out.where(F.col(id_col).between(low, high))
    return out.select(*schema.fieldNames()) if schema is not None else out
