"""Deep pages in any sort order: sorted copies of the dashboard.

A copy is written once in one sort order (key, then id) as a numbered part: its
rows' places are their ranks. Page n is a range of ranks, which bounds the
stored place, so that a page reads the row groups that hold it and nothing
before them, however deep it lies. Filters and unpublished orders go through
``query.query_items``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shelfspark.operators.commits import commit, snapshot
from shelfspark.operators.numbered import read_numbered, write_split
from shelfspark.operators.query import check_page, sort_items
from shelfspark.schemas import ITEM_PAGE_SIZE_MAX, NUMERIC_SORT_COLUMNS, STOCK_ITEMS

ROW_GROUP_BYTES = 8 << 20
RANK = "_rank"


def copy_name(table: str, sort_by: str, sort_dir: str) -> str:
    return f"{table}_by_{sort_by}_{'desc' if sort_dir == 'desc' else 'asc'}"


def publish_sorted(items: DataFrame, root: str, table: str, sort_by: str, sort_dir: str = "asc", numeric_cols=NUMERIC_SORT_COLUMNS,
                   legacy_null_text: bool = False, partitions: int | None = None) -> str:
    """Write the copy of ``items`` (rows of the committed ``table`` of ``root``)
    in one sort order and commit it, with the folders that it was made from."""
    spark = items.sparkSession
    state = snapshot(spark, root)
    name = copy_name(table, sort_by, sort_dir)
    path = os.path.join(root, name, f"v-{uuid.uuid4().hex}")
    order = sort_items(items, sort_by, sort_dir, numeric_cols, legacy_null_text)
    entry = write_split(items, path, order, partitions, ROW_GROUP_BYTES) | {"id": RANK}
    commit(spark, root, lambda now: now._replace(tables=now.tables | {name: [path]}, parts=now.parts | {path: entry},
                                                 made_from=now.made_from | {name: {table: state.paths(table)}}), None, state, [table])
    return name


def sorted_page(spark: SparkSession, root: str, table: str, sort_by: str, sort_dir: str = "asc", page: int = 1, page_size: int = 50,
                schema: T.StructType = STOCK_ITEMS) -> DataFrame:
    """Page ``page`` of a published order, in that order. A copy that is not of
    the table's committed version raises."""
    check_page(page, page_size, ITEM_PAGE_SIZE_MAX)
    state = snapshot(spark, root)
    name = copy_name(table, sort_by, sort_dir)
    paths = state.paths(name)
    if not paths or state.made_from.get(name) != {table: state.paths(table)}:
        raise ValueError(f"{name} is not a copy of the current {table}")
    low = (page - 1) * page_size + 1
    ranked = T.StructType([T.StructField(RANK, T.LongType()), *schema.fields])
    found = read_numbered(spark, state, name, RANK, ranked, (low, low + page_size - 1))
    return found.orderBy(RANK).drop(RANK)


def sorted_total(spark: SparkSession, root: str, table: str, sort_by: str, sort_dir: str = "asc") -> int:
    """Rows of a published order, as its commit tells: nothing is scanned."""
    state = snapshot(spark, root)
    return sum(state.parts[p]["rows"] for p in state.paths(copy_name(table, sort_by, sort_dir)))


