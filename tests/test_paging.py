import os

import pytest

from shelfspark.operators import paging, query, tables
from shelfspark.schemas import NUMERIC_SORT_COLUMNS, STOCK_ITEMS

@pytest.fixture(scope="module")
def board(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("paging"))
    rows = [(i, f"SKU-{i * 37 % 101}", None if i % 9 == 0 else f"Name {i % 13}", "M", ["econ", "LARGE", None, ""][i % 4], "L", float(i % 7), 1.0, "c", 2.0, 3.0,
             None if i % 11 == 0 else i * 7919 % 50, i % 3, 0, 1, "2024") for i in range(1, 2001)]
    items = spark.createDataFrame([r for r in rows], STOCK_ITEMS).repartition(4)
    tables.publish(items, os.path.join(root, "stock_items"), sort_within="id")
    return root, tables.current(spark, os.path.join(root, "stock_items"), STOCK_ITEMS).cache()

@pytest.mark.parametrize("sort_by,sort_dir", [("category", "asc"), ("item_name", "desc"), ("available_atp", "desc"), ("cost", "asc"), ("no such column", "asc")])
def test_pages_of_a_sorted_copy_equal_offset_pages(spark, board, sort_by, sort_dir):
    root, items = board
    paging.publish_sorted(items, root, "stock_items", sort_by, sort_dir, partitions=5)
    for page, size in ((1, 50), (7, 50), (4, 500), (40, 50), (41, 50), (1999, 1)):
        want = query.query_items(items, sort_by=sort_by, sort_dir=sort_dir, page=page, page_size=size).items.collect()
        assert paging.sorted_page(spark, root, "stock_items", sort_by, sort_dir, page, size).collect() == want
    assert paging.sorted_total(spark, root, "stock_items", sort_by, sort_dir) == 2000

def test_a_page_bounds_the_scan_and_a_stale_copy_raises(spark, board):
    root, items = board
    paging.publish_sorted(items, root, "stock_items", "fba_stock", "asc", partitions=5)
    page = paging.sorted_page(spark, root, "stock_items", "fba_stock", "asc", 3, 100)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_row," in plan and "LessThanOrEqual(_row," in plan  # pushed to the files
    with pytest.raises(ValueError):
        paging.sorted_page(spark, root, "stock_items", "size", "asc", 1, 10)  # never published
    with pytest.raises(ValueError):
        paging.sorted_page(spark, root, "stock_items", "fba_stock", "asc", 1, 501)
    tables.publish(items.limit(3), os.path.join(root, "stock_items"))
    with pytest.raises(ValueError):
        paging.sorted_page(spark, root, "stock_items", "fba_stock", "asc", 1, 10)

def test_empty_table(spark, tmpdir_path):
    empty = spark.createDataFrame([], STOCK_ITEMS)
    tables.publish(empty, os.path.join(tmpdir_path, "t"))
    paging.publish_sorted(empty, tmpdir_path, "t", "size")
    assert paging.sorted_page(spark, tmpdir_path, "t", "size").collect() == []

