import pytest

from shelfspark.operators import query

ROWS = [
    # id, sku_code, item_name, category, available_atp, fba_stock, cost
    (1, "SKU-1", "Red 100%_off", "Shirts", 5, 1, 10.0),
    (2, "SKU-2", None, "shirts", 0, 1, None),
    (3, "SKU-3", "Blue", None, 7, 3, 2.5),
    (4, "SKU-4", "Green", "", -1, 1, 10.0),
    (5, "ABC-5", "sku-x", "Pants", 5, 0, 1.0),
]
SCHEMA = "id long, sku_code string, item_name string, category string, available_atp long, fba_stock long, cost double"


@pytest.fixture()
def items(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return [r.id for r in df.collect()]


def test_search_literal_and_either_column(items):
    assert sorted(ids(query.query_items(items, search="sku").matching)) == [1, 2, 3, 4, 5]
    assert ids(query.query_items(items, search="%_").matching) == [1]


def test_status_filter_without_column_is_empty(items):
    assert ids(query.query_items(items, status="active").matching) == []


def test_availability(items):
    assert sorted(ids(query.query_items(items, availability="yes").matching)) == [1, 3, 5]
    assert sorted(ids(query.query_items(items, availability="no").matching)) == [2, 4]
    assert ids(query.query_items(items, availability="7").matching) == [3]


def test_category_substring_case_insensitive(items):
    assert sorted(ids(query.query_items(items, category="SHIRT").matching)) == [1, 2]


def test_sort_ties_keep_id_order_both_directions(items):
    asc = ids(query.query_items(items, sort_by="fba_stock", sort_dir="asc").items)
    desc = ids(query.query_items(items, sort_by="fba_stock", sort_dir="desc").items)
    assert asc == [5, 1, 2, 4, 3]
    assert desc == [3, 1, 2, 4, 5]


def test_sort_numeric_null_as_zero_and_text(items):
    assert ids(query.query_items(items, sort_by="cost").items) == [2, 5, 3, 1, 4]
    # text sort, null as ''
    assert ids(query.query_items(items, sort_by="category").items) == [3, 4, 5, 1, 2]
    # unknown column: id order
    assert ids(query.query_items(items, sort_by="nope", sort_dir="desc").items) == [1, 2, 3, 4, 5]


def test_paging(items):
    r = query.query_items(items, page=2, page_size=2)
    assert ids(r.items) == [3, 4]
    assert r.total() == 5 and r.total_pages() == 3
    assert ids(query.query_items(items, page=9, page_size=2).items) == []
    empty = query.query_items(items, search="zzz")
    assert empty.total() == 0 and empty.total_pages() == 1
    exact = query.query_items(items, page_size=5)
    assert exact.total_pages() == 1


def test_page_validation(items):
    with pytest.raises(ValueError):
        query.query_items(items, page=0)
    with pytest.raises(ValueError):
        query.query_items(items, page_size=501)


def test_page_plan_is_take_ordered(items):
    plan = query.query_items(items, sort_by="cost", page=2, page_size=2).items._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_kpis_over_unfiltered(items):
    from pyspark.sql import functions as F
    k = query.kpis(items.withColumns({"sjit_stock": F.lit(1), "fbf_stock": F.lit(None)})).first()
    assert (k.total_sjit, k.total_fbf) == (5, 0)
    assert (k.total_skus, k.total_stock, k.total_available, k.total_fba) == (5, 16, 16, 6)


def test_visibility(items):
    assert query.visible_columns("viewer")["visible"] == ["sku_code", "item_name", "size", "category", "location"]
    perms = {"item_master": {"visible": ["sku_code", "cost"]}}
    v = query.visible_columns("viewer", perms)
    assert v["visible"] == ["sku_code", "cost"] and v["editable"] == ["cost"]
    assert len(query.visible_columns("admin")["visible"]) == 15


def test_distinct_values_sorted_non_blank(items):
    assert [r.category for r in query.distinct_values(items, "category").collect()] == ["Pants", "Shirts", "shirts"]


def test_logs(spark):
    logs = spark.createDataFrame([(i, f"User{i % 3}", "LOGIN" if i % 2 else "login") for i in range(1, 11)],
                                 "id long, username string, action string")
    r = query.query_logs(logs, action="LOGIN", username="user1", page=1, page_size=2)
    assert ids(r.items) == [1, 7]
    with pytest.raises(ValueError):
        query.query_logs(logs, page_size=201)


def test_find_items(items):
    assert ids(query.find_items(items, prefix="sku-")) == [1, 2, 3, 4]
    assert ids(query.find_items(items, keys=["SKU-2", "X"])) == [2]
    assert ids(query.find_items(items, item_id=99)) == []


def test_pushdown_and_pruning_on_published_table(spark, tmpdir_path):
    import os
    from shelfspark.operators import tables
    from shelfspark.schemas import STOCK_ITEMS
    rows = [(i, f"SKU-{i}", "n", "M", "c", "L", 1.0, 2.0, "cat", 3.0, 4.0, i, 0, 0, 0, "") for i in range(1, 50)]
    tables.publish(spark.createDataFrame(rows, STOCK_ITEMS), os.path.join(tmpdir_path, "stock_items"), batch_id=0)
    items = tables.current(spark, os.path.join(tmpdir_path, "stock_items"), STOCK_ITEMS)
    plan = query.find_items(items, item_id=17)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,17)]" in plan
    plan = query.find_items(items, keys=["SKU-1", "SKU-2"])._jdf.queryExecution().executedPlan().toString()
    assert "In(sku_code, [SKU-1,SKU-2])" in plan
    plan = query.export_view(items)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema:"):].splitlines()[0]
    assert "up_price" not in schema and "id:" not in schema and "sku_code" in schema


def test_keyset_logs_matches_offset_paging(spark):
    logs = spark.createDataFrame([(i, f"User{i % 4}", "LOGIN" if i % 3 else "EXPORT") for i in range(1, 200)],
                                 "id long, username string, action string")
    by_offset = [r.id for r in query.query_logs(logs, action="LOGIN", username="user1", page=3, page_size=10).items.collect()]
    page2_last = [r.id for r in query.query_logs(logs, action="LOGIN", username="user1", page=2, page_size=10).items.collect()][-1]
    by_key = [r.id for r in query.keyset_logs(logs, page2_last, 10, action="LOGIN", username="user1").collect()]
    assert by_key == by_offset and len(by_key) == 10
