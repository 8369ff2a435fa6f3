"""The dashboard kept current by change sets.

The item master and the dashboard are kept in slices (``numbered.py``). A refresh
or an import first finds the SKUs that it changes, then the slices that hold
them (a scan of the key column alone), and writes only those slices anew. The
commit lists the new folders in the places of the old ones; row numbers and
dashboard ids follow from the slices' row counts, so they equal those of a full
rebuild, also after deletions.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.scalars import ck
from shelfspark.operators.commits import Snapshot
from shelfspark.operators.numbered import MAX_SLICES, SLICE_ROWS, TASK_BITS, read_parts, write_parts, write_slices
from shelfspark.operators.tables import Slices, assign_ids
from shelfspark.schemas import ITEM_MASTER, STOCK_COLUMNS, STOCK_ITEMS

BOARD_STOCK = dict(zip(["available_atp", "fba_stock", "fbf_stock", "sjit_stock"], STOCK_COLUMNS))


def _stored_schema(schema: T.StructType) -> T.StructType:
    """The stored columns of a numbered table: all but the number."""
    return T.StructType(schema.fields[1:])


def in_slices(state: Snapshot, name: str) -> bool:
    return bool(state.paths(name)) and all("part" in state.parts.get(p, {}) and "tasks" not in state.parts[p] for p in state.paths(name))


def aligned(state: Snapshot, one: str, other: str) -> bool:
    """Whether two tables are in slices of the same rows."""
    if not (in_slices(state, one) and in_slices(state, other)):
        return False
    rows = [[state.parts[p]["rows"] for p in state.paths(n)] for n in (one, other)]
    return rows[0] == rows[1]


def slice_size(rows: int) -> int:
    """Rows of a slice: more than SLICE_ROWS only where there would be too many slices."""
    return max(SLICE_ROWS, -(-rows // (MAX_SLICES // 2)))


def changed_stock(old: DataFrame, newest: DataFrame) -> DataFrame:
    """The rows of ``newest`` (one per SKU) that ``old`` lacks or holds with other values."""
    before = old.select("master_sku", F.struct(*STOCK_COLUMNS).alias("_old"))
    joined = newest.join(before, "master_sku", "left")
    return joined.where(~F.struct(*STOCK_COLUMNS).eqNullSafe(F.col("_old"))).select("master_sku", *STOCK_COLUMNS)


def holding(spark: SparkSession, state: Snapshot, name: str, key: Column, column: str, keys: DataFrame) -> list[str]:
    """Folders of the slices of a table that hold one of ``keys`` (one column,
    ``_key``), in order. Only the key column is scanned."""
    paths = state.paths(name)
    rows = read_parts(spark, paths, T.StructType([T.StructField(column, T.StringType())]))
    hit = rows.select(key.alias("_key"), "_part").join(keys, "_key", "left_semi").select("_part").distinct()
    found = {r["_part"] for r in hit.collect()}  # at most one per slice
    return [p for p in paths if state.parts[p]["part"] in found]


def _rows_of(spark: SparkSession, paths: list[str], parts: dict[str, dict], schema: T.StructType) -> DataFrame:
    """Stored rows of some slices, with ``_slice`` (their place in ``paths``) and ``_row``."""
    place = spark.createDataFrame([(parts[p]["part"], i) for i, p in enumerate(paths)], "_part string, _slice int")
    return read_parts(spark, paths, _stored_schema(schema)).join(F.broadcast(place), "_part").drop("_part")


def _rewrite(rows: DataFrame, base: str, old: list[str]) -> dict[str, tuple[str, dict] | None]:
    """Write the slices of ``rows`` (``_slice``: place in ``old``) anew: old folder
    -> new folder and its entry, None where no row is left."""
    version = uuid.uuid4().hex
    named = rows.withColumn("_part", F.concat(F.lit(f"{version}:"), F.col("_slice").cast("string")))
    paths, parts = write_parts(named, os.path.join(base, f"v-{version}"), version)
    new = {int(p.rpartition("=")[2]): (p, parts[p]) for p in paths}
    return {p: new.get(i) for i, p in enumerate(old)}


def _replaced(paths: list[str], new: dict, added: tuple[list[str], dict] = ([], {})) -> Slices:
    after = [new[p][0] if p in new else p for p in paths if p not in new or new[p] is not None]
    return Slices(after + added[0], {x[0]: x[1] for x in new.values() if x is not None} | added[1])


def update_stock(spark: SparkSession, root: str, state: Snapshot, name: str, changes: DataFrame) -> Slices:
    """The dashboard with the stock of the changed SKUs."""
    old = holding(spark, state, name, F.col("sku_code"), "sku_code", changes.select(F.col("master_sku").alias("_key")))
    if not old:
        return Slices(state.paths(name), {})
    rows = _rows_of(spark, old, state.parts, STOCK_ITEMS)
    new = changes.select(F.col("master_sku").alias("_key"), *[F.col(s).alias(f"_{b}") for b, s in BOARD_STOCK.items()], F.lit(True).alias("_hit"))
    joined = rows.join(new, F.col("sku_code") == F.col("_key"), "left")
    out = joined.select(*[F.when(F.col("_hit"), F.coalesce(F.col(f"_{c}"), F.lit(0)).cast("bigint")).otherwise(F.col(c)).alias(c)
                          if c in BOARD_STOCK else F.col(c) for c in rows.columns])
    return _replaced(state.paths(name), _rewrite(out, os.path.join(root, name), old))


def whole_items(spark: SparkSession, root: str, name: str, items: DataFrame, order: list[str], slice_rows: int | None = None) -> Slices:
    """The item master in slices, numbered densely in ``order``."""
    numbered = assign_ids(items, order, id_col="_n")
    rows = numbered.select("_n", *ITEM_MASTER.fieldNames()[1:])
    return Slices(*write_slices(rows, os.path.join(root, name), slice_rows=slice_rows or slice_size(numbered.count())))


def whole_board(root: str, name: str, board: DataFrame, slice_rows: int) -> Slices:
    """A dashboard whose ``row_no`` is dense, in slices."""
    return Slices(*write_slices(board, os.path.join(root, name), "row_no", slice_rows))


def changed_items(spark: SparkSession, root: str, state: Snapshot, name: str, keys: DataFrame, apply) -> tuple[Slices, list[str], list[str]]:
    """The item master after an import that touches ``keys``: ``apply`` turns the
    items of the slices that hold them into the new ones (``src`` 0: kept, 1:
    added; ``src_row``: order). Returns the slices, and the old and the added
    folders among them that are not as they were."""
    old = holding(spark, state, name, ck("master_sku"), "master_sku", keys)
    rows = _rows_of(spark, old, state.parts, ITEM_MASTER) if old else None
    placed = F.shiftleft(F.col("_slice").cast("long"), TASK_BITS) + F.col("_row")
    before = (rows.select(placed.alias("row_no"), *ITEM_MASTER.fieldNames()[1:]) if old else spark.createDataFrame([], ITEM_MASTER))
    after = apply(before)
    base, stored = os.path.join(root, name), ITEM_MASTER.fieldNames()[1:]
    new = {}
    if old:
        kept = after.where("src = 0").withColumn("_slice", F.shiftright("src_row", TASK_BITS).cast("int"))
        # a slice's rows close up after deletions; a slice is bounded
        place = F.row_number().over(Window.partitionBy("_slice").orderBy("src_row")) - 1
        new = _rewrite(kept.withColumn("_row", place.cast("long")).select(*stored, "_slice", "_row"), base, old)
    numbered = assign_ids(after.where("src = 1"), ["src_row"], id_col="_n").select("_n", *stored)
    added = write_slices(numbered, base)
    slices = _replaced(state.paths(name), new, added)
    return slices, old, added[0]


def changed_board(spark: SparkSession, root: str, state: Snapshot, name: str, items: str, new_items: Slices, old: list[str], build) -> Slices:
    """The dashboard after ``changed_items``: ``build`` makes dashboard rows of
    the items (``row_no`` is kept) of the slices that changed or were added."""
    of_item = dict(zip(state.paths(items), state.paths(name)))  # aligned
    fresh = [p for p in new_items.paths if p in new_items.parts]
    if not fresh:
        return Slices([of_item[p] for p in state.paths(items) if p not in old], {})
    rows = _rows_of(spark, fresh, new_items.parts, ITEM_MASTER)
    placed = F.shiftleft(F.col("_slice").cast("long"), TASK_BITS) + F.col("_row")
    board = build(rows.select(placed.alias("row_no"), *ITEM_MASTER.fieldNames()[1:]))
    out = board.withColumn("_slice", F.shiftright("row_no", TASK_BITS).cast("int")) \
        .withColumn("_row", F.col("row_no").bitwiseAND(F.lit((1 << TASK_BITS) - 1))).drop("row_no")
    new = _rewrite(out, os.path.join(root, name), fresh)
    paths = [new[p][0] if p in new else of_item[p] for p in new_items.paths]
    return Slices(paths, {x[0]: x[1] for x in new.values() if x is not None})
