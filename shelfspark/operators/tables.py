"""Set-based table maintenance: keyed upsert, partial update, delete, gap-free
ids, versioned publish and generic file-to-table loads.

Tables are Parquet directories. A publish writes a new version directory and
then adds a commit that names it, so readers never see a half-written or
empty table (the reference empties the table first).
"""

from __future__ import annotations

import os
import uuid
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators.commits import Snapshot, commit, commits, file_system, read_commit, snapshot  # noqa: F401
from shelfspark.operators.numbered import MAX_PARTITIONS, TASK_BITS, read_numbered, read_parts, with_numbers, write_split
from shelfspark.session import checkpoint_dir


def _cols(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def last_per_key(rows: DataFrame, key, cols, order) -> DataFrame:
    """One row per key: the values of the row that is last in ``order``.

    ``max_by`` is a partial aggregate, so a key holding a large share of the
    rows is combined map-side before the shuffle.
    """
    key, cols, order = _cols(key), _cols(cols), _cols(order)
    order_col = F.struct(*order) if len(order) > 1 else F.col(order[0])
    agg = rows.groupBy(*key).agg(F.max_by(F.struct(*cols), order_col).alias("_v"))
    return agg.select(*key, *[F.col("_v")[c].alias(c) for c in cols])


INTEGRAL = ("bigint", "int", "smallint", "tinyint")


def packed_order(rows: DataFrame, order, wide: bool = False) -> Column:
    """An expression of ``rows`` that sorts like the columns ``order``: one number,
    if they are whole numbers whose ranges fit together into the 62 bits of a long
    (``wide``: or into the 124 of a decimal), else a struct. A number keeps the buffers of ``max_by``
    fixed-width, so that Spark aggregates by hash; with a struct every task sorts
    all of its rows. The ranges come from one aggregate over these columns alone;
    nulls are not packed."""
    order = _cols(order)
    types = dict(rows.dtypes)
    if len(order) == 1 and types[order[0]] in INTEGRAL:
        return F.col(order[0])
    if not all(types[c] in NUMERIC for c in order):
        return F.struct(*order)
    whole = [F.coalesce(F.bool_and(F.col(c) == F.floor(c)), F.lit(False)) if types[c] not in INTEGRAL else F.lit(True) for c in order]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(order) for x in (
        F.min(c).alias(f"low{i}"), F.max(c).alias(f"high{i}"), F.count(c).alias(f"n{i}"), whole[i].alias(f"whole{i}"))]).first()
    if not seen["n"] or not all(seen[f"whole{i}"] and seen[f"n{i}"] == seen["n"] and abs(seen[f"low{i}"]) < 2**53 and abs(seen[f"high{i}"]) < 2**53
                                for i in range(len(order))):
        return F.struct(*order)
    bits = [(int(seen[f"high{i}"]) - int(seen[f"low{i}"])).bit_length() for i in range(len(order))]
    if sum(bits) > (2 * 62 if wide else 62):
        return F.struct(*order)
    # each long takes the columns that fit: two, or three where little of one is left
    words, packed, used = [], F.lit(0).cast("bigint"), 0
    for i, c in enumerate(order):
        if used + bits[i] > 62:
            words.append((packed, used))
            packed, used = F.lit(0).cast("bigint"), 0
        packed = F.shiftleft(packed, bits[i]) + (F.col(c).cast("bigint") - F.lit(int(seen[f"low{i}"])))
        used += bits[i]
    whole = packed if not words else words[0][0].cast("decimal(38,0)")
    for word, n in [*words[1:], (packed, used)] if words else []:
        whole = whole * F.lit(Decimal(1 << n)) + word.cast("decimal(20,0)")
    return whole


NUMERIC = ("bigint", "int", "smallint", "tinyint", "double", "float")


def upsert(target: DataFrame, updates: DataFrame, key, cols, order=None, unique_inputs: bool = False) -> DataFrame:
    """Keyed upsert: a key present in ``updates`` takes the update (the last one
    in ``order`` when several), other target rows are kept unchanged, new keys
    are inserted. One shuffle on the key (union, then one grouped max_by).

    ``unique_inputs=True`` promises one row per key on each side; with
    numeric columns each column then takes its own ``max_by`` over the side
    flag - fixed-width buffers, so a hash aggregate instead of a sort."""
    key, cols = _cols(key), _cols(cols)
    types = dict(updates.dtypes)
    if unique_inputs and not order and all(types[c] in NUMERIC for c in cols):
        t = target.select(*key, *cols, F.lit(0).alias("_side"))
        u = updates.select(*key, *cols, F.lit(1).alias("_side"))
        return t.unionByName(u).groupBy(*key).agg(*[F.max_by(F.col(c), F.col("_side")).alias(c) for c in cols])
    order = _cols(order) if order else []
    t = target.select(*key, *cols, F.lit(0).alias("_side"), *[F.lit(None).cast(updates.schema[o].dataType).alias(o) for o in order])
    u = updates.select(*key, *cols, F.lit(1).alias("_side"), *order)
    rank = F.struct(F.col("_side"), *[F.col(o) for o in order])
    merged = t.unionByName(u).groupBy(*key).agg(F.max_by(F.struct(*cols), rank).alias("_v"))
    return merged.select(*key, *[F.col("_v")[c].alias(c) for c in cols])


def update_matched(target: DataFrame, updates: DataFrame, key, cols) -> DataFrame:
    """Keyed partial update: matched target rows take the given columns from
    ``updates`` (one row per key), all other columns and rows are kept."""
    key, cols = _cols(key), _cols(cols)
    u = updates.select(*key, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = target.join(u, on=key, how="left")
    out = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
           for c in target.columns]
    return joined.select(*out)


def delete_matched(target: DataFrame, keys: DataFrame, key) -> DataFrame:
    """Keyed delete: drop target rows whose key appears in ``keys``."""
    key = _cols(key)
    return target.join(keys.select(*key).distinct(), on=key, how="left_anti")


def with_defaults(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    """Cast to a declared schema and fill declared defaults (missing columns get the default)."""
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def duplicate_keys(df: DataFrame, key) -> DataFrame:
    """Keys that occur more than once, with their count."""
    key = _cols(key)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > 1)


def assign_ids(df: DataFrame, order, start: int = 1, id_col: str = "id", partitions: int | None = None, cells=None) -> DataFrame:
    """Gap-free consecutive ids in ``order`` without a single-partition window.

    The rows are range-partitioned and sorted on ``order`` and written once, as
    Parquet, into the shared checkpoint folder, so partition contents are fixed
    even if an executor is lost; a reader of the result scans only the columns
    it needs. Each row's id is the number of rows in the partitions before
    (one count per partition) plus its position. The number of partitions
    follows the size of the input and is bounded, and so is the table of
    offsets that is broadcast. Rows that tie on ``order`` are told apart by
    their scan position, so even a value shared by a large share of the rows
    is spread over several range partitions (ids among such ties follow the
    input order; give a unique ``order`` for ids that do not depend on it).
    ``cells`` (a function of the sorted rows) makes the columns that are written.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c != id_col or c in _cols(order)]
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]  # Parquet has no such type
    kept = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in void else F.col(f"`{c}`") for c in rest])
    path = os.path.join(checkpoint_dir(spark), f"ids-{uuid.uuid4().hex}")
    entry = write_split(kept, path, _cols(order), partitions, cells=cells)
    if cells:
        kept = cells(kept)
        rest = kept.columns
    rows = read_parts(spark, [path], kept.schema) if entry["rows"] else spark.createDataFrame([], kept.schema).withColumns(
        {"_part": F.lit(""), "_row": F.lit(0).cast("long")})
    out = with_numbers(rows, [path], {path: entry}, id_col, start)
    return out.select(id_col, *[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in rest if c != id_col])


def assign_block_ids(df: DataFrame, block: list[str], place: str, start: int = 1, id_col: str = "id") -> DataFrame:
    """``assign_ids`` in the order ``block``, ``place`` for rows that come block by
    block, as those of a file scan do: nothing is shuffled or sampled. Every task
    sorts and writes its own rows, and a row's id is the number of rows in the blocks
    before (one count per block) plus its position in the block. Rows whose blocks
    are spread over tasks are numbered by ``assign_ids``."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c != id_col]
    path = os.path.join(checkpoint_dir(spark), f"ids-{uuid.uuid4().hex}")
    rows = df.select(*[F.col(f"`{c}`") for c in rest])
    rows.sortWithinPartitions(*block, place).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    written = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_row", T.LongType())])).parquet(path)
    task = F.shiftright("_row", TASK_BITS).alias("_task")
    found = (written.groupBy(*block, task).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
             .limit(MAX_PARTITIONS + 1).collect())
    names = {tuple(r[b] for b in block) for r in found}
    if len(names) < len(found) or len(found) > MAX_PARTITIONS or any(x is None for name in names for x in name):
        return assign_ids(written.drop("_row"), [*block, place], start, id_col)
    places, before = [], start
    for r in sorted(found, key=lambda r: tuple(r[b] for b in block)):
        places.append((*[r[b] for b in block], before - r["_first"]))
        before += r["_n"]
    schema = T.StructType([*[rows.schema[b] for b in block], T.StructField("_shift", T.LongType())])
    numbered = written.join(F.broadcast(spark.createDataFrame(places, schema)), block)
    return numbered.select((F.col("_row") + F.col("_shift")).alias(id_col), *[F.col(f"`{c}`") for c in rest])


def next_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """max(id) + 1, or 1 for an empty table (one row)."""
    return df.agg((F.coalesce(F.max(id_col), F.lit(0)) + 1).cast("bigint").alias("next_id"))


# ---------------------------------------------------------------------------
# Versioned tables
# ---------------------------------------------------------------------------
#
# Tables of one root folder share a log of commits (``commits.py``). Data is
# written into a fresh folder per attempt before its commit, so neither a failed
# nor a repeated attempt touches what readers or later batches see.


def _split(base: str) -> tuple[str, str]:
    root, name = os.path.split(base.rstrip("/"))
    return root, name


def _commit(spark: SparkSession, root: str, change, batch: str | None) -> None:
    """Add a commit: ``change`` maps the tables of the newest commit to the new ones."""
    commit(spark, root, lambda now: now._replace(tables=change(now.tables)), batch)


def _write_version(df: DataFrame, base: str, schema, unique_key, sort_within, defaults: dict | None = None) -> str:
    if schema is not None:
        df = with_defaults(df, schema, defaults or {})
    if sort_within:
        df = df.sortWithinPartitions(*_cols(sort_within))
    path = os.path.join(base, f"v-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if unique_key is not None:
        dup = duplicate_keys(df.sparkSession.read.schema(df.schema).parquet(path), unique_key).limit(1).collect()
        if dup:
            raise ValueError(f"duplicate key in publish: {dup[0].asDict()}")
    return path


class Slices(NamedTuple):
    """A numbered table's folders in order (old ones may be among them) and the entries of the new ones."""
    paths: list[str]
    parts: dict[str, dict]


def publish_together(spark: SparkSession, root: str, frames: dict, batch: str | None = None, based_on: Snapshot | None = None,
                     reads=(), made_from: dict | None = None) -> dict[str, list[str]]:
    """Write several tables of ``root`` and switch them with one commit.
    ``frames``: name -> DataFrame, or (DataFrame, options of ``publish``), or
    ``Slices`` that are written already. ``batch`` names the streaming batch
    that made them. ``based_on`` and ``reads`` are the snapshot and its tables
    that they were worked out from: if one changed since, ``Conflict`` is raised
    and nothing is switched. ``made_from``: name -> the folders, by table, that
    a derived table shows."""
    paths, parts, origin = {}, {}, dict(made_from or {})
    for name, frame in frames.items():
        if isinstance(frame, Slices):
            paths[name], new = list(frame.paths), frame.parts
            parts |= new
        else:
            df, options = frame if isinstance(frame, tuple) else (frame, {})
            paths[name] = [_write_version(df, os.path.join(root, name), options.get("schema"), options.get("unique_key"),
                                          options.get("sort_within"), options.get("defaults"))]
    # what a derived table shows includes the tables written with it
    origin = {name: {t: paths.get(t, p) for t, p in shown.items()} for name, shown in origin.items()}

    def change(now: Snapshot) -> Snapshot:
        kept = {n: m for n, m in now.made_from.items() if n not in paths}
        return now._replace(tables=now.tables | paths, parts=now.parts | parts, made_from=kept | origin)

    commit(spark, root, change, batch, based_on, reads)
    return paths


def publish(df: DataFrame, base: str, batch_id=None, schema: T.StructType | None = None,
            unique_key=None, sort_within=None, defaults: dict | None = None) -> str:
    """Write ``df`` as a new version of the table at ``base`` and switch to it.
    The written files are checked for repeats of ``unique_key`` before the
    switch; a failing check raises and leaves the table as it was.
    ``sort_within`` sorts each output file on those columns, so Parquet's
    row-group min/max statistics let lookups on them skip most of the file
    (the role the reference's database indexes play). ``defaults`` gives the
    declared value of null or missing cells of ``schema``."""
    root, name = _split(base)
    options = {"schema": schema, "unique_key": unique_key, "sort_within": sort_within, "defaults": defaults}
    return publish_together(df.sparkSession, root, {name: (df, options)}, None if batch_id is None else str(batch_id))[name][0]


def _versions_exist(spark: SparkSession, base: str) -> bool:
    fs, folder = file_system(spark, base)
    return bool(fs.exists(folder)) and any(st.getPath().getName().startswith("v-") for st in fs.listStatus(folder))


def current_paths(spark: SparkSession, base: str) -> list[str]:
    """Folders of the committed version of a table; none if there is no commit of it."""
    root, name = _split(base)
    return snapshot(spark, root).paths(name)


def table_of(spark: SparkSession, state: Snapshot, name: str, schema: T.StructType, between: tuple[int, int] | None = None) -> DataFrame:
    """A table of a snapshot, typed empty without one. The first column of a
    table in numbered parts is the row number, worked out when it is read;
    ``between`` takes only the rows of those numbers."""
    paths = state.paths(name)
    number = schema.fieldNames()[0]
    if not paths:
        return spark.createDataFrame([], schema)
    if paths[0] in state.parts:
        return read_numbered(spark, state, name, number, schema, between)
    out = spark.read.schema(schema).parquet(*paths)
    return out if between is None else out.where(F.col(number).between(*between))


def current(spark: SparkSession, base: str, schema: T.StructType, between: tuple[int, int] | None = None) -> DataFrame:
    """The committed version of a table, or a typed empty table when none was
    ever written. Written data without a commit raises: it is not known
    whether the table is empty."""
    root, name = _split(base)
    state = snapshot(spark, root)
    if not state.paths(name) and _versions_exist(spark, base) and name not in state.tables:
        raise ValueError(f"{base} has data but no committed version")
    return table_of(spark, state, name, schema, between)


def state_before(spark: SparkSession, base: str, schema: T.StructType, batch: str | None) -> DataFrame:
    """The committed version, or, if the newest commit that carries a batch of
    the same stream is this very batch, the version before that commit. Typed
    empty without any.

    ``batch`` is ``<stream>#<number>``; None (a single run) is never a retry."""
    root, name = _split(base)
    state = snapshot(spark, root)
    done = state.streams.get((batch or "").rpartition("#")[0])
    if batch is not None and done is not None and done["batch"] == batch:
        found = read_commit(spark, root, done["commit"])
        state = state._replace(tables=found["before"] if found is not None else state.tables)
    return table_of(spark, state, name, schema)


def load_table(df: DataFrame, base: str, name: str, action: str = "append", id_col: str | None = "id") -> str:
    """Load rows into a named all-text table: create when absent, append, or
    replace. Column names are cleaned (stripped, backticks removed); every
    value is stored as text and missing cells stay null. Rows get consecutive
    ids in ``id_col`` (None: no ids), going on after the last one; an append
    must bring exactly the table's columns. The load is one commit: readers see
    the table before it or after it.

    The rows are written once, in file order; their ids follow from the place
    that the commit gives them, so of loads that overlap each comes whole and
    after the other."""
    action = action.lower()
    if action not in ("append", "replace"):
        raise ValueError("action must be 'append' or 'replace'")
    spark, path = df.sparkSession, os.path.join(base, name)
    text = as_text_table(df)
    if id_col in text.columns:
        text = text.drop(f"`{id_col}`") if "." in id_col else text.drop(id_col)

    def check(old: list[str]) -> None:
        if action == "append" and old:
            have = [c for c in spark.read.parquet(old[0]).columns if c not in ("_part", "_row", id_col)]
            if sorted(have) != sorted(text.columns):
                raise ValueError(f"columns differ: the table has {have}, the file {text.columns}")

    check(current_paths(spark, path))
    written = os.path.join(path, f"v-{uuid.uuid4().hex}")
    if id_col is not None:
        entry = {written: write_split(text, written) | {"id": id_col}}
    else:
        text.write.parquet(written)
        entry = {}

    def change(now: Snapshot) -> Snapshot:
        old = now.paths(name) if action == "append" else []
        check(old)  # the table may have been replaced since
        return now._replace(tables=now.tables | {name: [*old, written]}, parts=now.parts | entry)

    commit(spark, base, change)
    return path


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A loaded table under its own columns; raises when it doesn't exist."""
    state = snapshot(spark, base)
    paths = state.paths(name)
    if not paths:
        raise ValueError(f"no table {name} at {base}")
    part = state.parts.get(paths[0])
    return spark.read.parquet(*paths) if part is None else read_numbered(spark, state, name, part["id"])


def clean_column_names(df: DataFrame) -> DataFrame:
    """Strip names and remove backticks (schema only, no job)."""
    return df.toDF(*[str(c).strip().replace("`", "") for c in df.columns])


def as_text_table(df: DataFrame) -> DataFrame:
    """The all-text form a file load stores: cleaned names, every value as text."""
    cleaned = clean_column_names(df)
    return cleaned.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cleaned.columns])


def table_counts(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame:
    """Row count per location; a location that cannot be read gives an error row."""
    parts = []
    schema = "path string, rows bigint, error string"
    for p in paths:
        try:
            d = spark.read.format(fmt).load(p)
            parts.append(d.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(p).alias("path"), F.col("rows"), F.lit(None).cast("string").alias("error")))
        except Exception as exc:  # missing path, bad format: reported as data
            parts.append(spark.createDataFrame([(p, None, str(exc))], schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out

