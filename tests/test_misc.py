import os

from pyspark.sql import functions as F

from shelfspark.operators import quality, query
from shelfspark.schemas import IMPORT_HISTORY, USER
from shelfspark.sources import files

USERS = [
    (1, "ana", "x", "admin", ["item_master"], None, True),
    (2, "raj", "y", "viewer", ["item_master"], {"item_master": {"visible": ["sku_code", "cost"], "editable": []}}, True),
    (3, "li", "z", "viewer", [], None, False),
]


def test_user_helpers(spark):
    users = spark.createDataFrame(USERS, USER)
    assert "password" not in query.public_users(users).columns
    vis = {r.username: r.visible for r in query.user_visible_columns(users).collect()}
    assert len(vis["ana"]) == 15 and vis["raj"] == ["sku_code", "cost"]
    assert vis["li"] == ["sku_code", "item_name", "size", "category", "location"]
    acc = {r.username: r.allowed for r in query.page_access(users, "item_master").collect()}
    assert acc == {"ana": True, "raj": True, "li": False}


def test_admin_kpis_and_history(spark):
    users = spark.createDataFrame(USERS, USER)
    logs = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00"), (3, "2024-01-01 23:59:00")],
                                 "id long, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    hist = spark.createDataFrame([(2, "b.csv", "ana", 3, 1, 1, 1, "ok", None), (1, "a.csv", "ana", 1, 1, 0, 0, "ok", None)],
                                 IMPORT_HISTORY)
    k = query.admin_kpis(users, logs, hist, "2024-01-01").first()
    assert (k.active_users, k.logs_today, k.total_imports) == (2, 2, 2)
    assert [r.id for r in query.import_history(hist).collect()] == [1, 2]


def test_change_flags(spark):
    logs = spark.createDataFrame([(1, None, "{}"), (2, "", None), (3, "a", "b")],
                                 "id long, old_values string, new_values string")
    got = {r.id: (r.has_old, r.has_new) for r in query.change_flags(logs).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, True)}


def test_kpi_difference_and_totals(spark):
    a = spark.createDataFrame([(1, 5)], "x long, y long")
    assert quality.kpi_difference(a, a).count() == 0
    b = spark.createDataFrame([(1, 6)], "x long, y long")
    assert sorted(r.side for r in quality.kpi_difference(a, b).collect()) == ["only_first", "only_second"]
    t = quality.column_totals(spark.createDataFrame([(1, None), (2, 3)], "x long, y long"), ["x", "y"]).first()
    assert (t.x, t.y) == (3, 3)


def test_observe_totals_on_write(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    observed, obs = quality.observe_totals(df, "stage1", ["a", "b"])
    observed.write.mode("overwrite").parquet(os.path.join(tmpdir_path, "o"))
    assert obs.get == {"rows": 2, "a": 4, "b": 6}


def test_key_profile_counts_null_once(spark):
    df = spark.createDataFrame([("A",), ("A",), (None,), (None,), ("B",)], "k string")
    p = quality.key_profile(df, "k").first()
    assert (p.rows, p.distinct_keys, p.surplus) == (5, 3, 2)


def test_write_csv_and_profile(spark, tmpdir_path):
    df = spark.createDataFrame([("SKU-1", 3), ("SKU-2", 4)], "sku string, qty long")
    p = files.write_csv(df.coalesce(1), os.path.join(tmpdir_path, "out"))
    prof = files.read_profile_csv(spark, p)
    assert dict(prof.dtypes)["qty"] == "int" and prof.count() == 2


def test_export_and_display(spark):
    items = spark.createDataFrame(
        [(1, "SKU-1", None, "M", "c", "L", 1.5, 2.0, "", 3.0, 4.0, 1234, 0, 0, -1, "")],
        "id long, sku_code string, item_name string, size string, category string, location string, cost double, "
        "price double, catalog string, mrp double, up_price double, available_atp long, fba_stock long, "
        "fbf_stock long, sjit_stock long, updated string")
    exp = query.export_view(items)
    assert exp.columns[0] == "Master SKU" and exp.columns[-1] == "Action" and "Up Price" not in exp.columns
    d = query.display_view(items, symbol="Rs ").first()
    assert (d.item_name, d.cost, d.available_atp, d.in_stock, d.catalog) == ("-", "Rs 1.50", "1,234", True, "")
    assert d.up_price == "4"


def test_small_helpers(spark, tmpdir_path):
    import pytest
    df = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3), (None, 4)], "k string, v long")
    assert query.lookup(df, "k", "A").count() == 1
    p = quality.key_profile(df, "k", approx=True).first()
    assert (p.rows, p.distinct_keys) == (4, 3)
    with pytest.raises(ValueError):
        quality.check_input(df, ["k", "missing"])
    with pytest.raises(ValueError):
        quality.check_input(df.filter("false"), ["k"])
    quality.check_input(df, ["k"])
    assert files.name_columns(df, ["a", "b"]).columns == ["a", "b"]
    items = spark.createDataFrame([(i, f"SKU-{i}", i % 3, 0, 0, 0) for i in range(1, 8)],
                                  "id long, sku_code string, available_atp long, fba_stock long, fbf_stock long, sjit_stock long")
    env = query.query_items(items, page=2, page_size=3).envelope()
    assert [r["id"] for r in env["items"]] == [4, 5, 6]
    assert (env["total"], env["total_pages"], env["stats"]["total_skus"]) == (7, 3, 7)


def test_multiline_quoted_breaks(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "m.csv")
    with open(p, "w") as f:
        f.write('banner\nSKU-1,"line one\nline two"\nSKU-2,x\n')
    df = files.read_positional_csv(spark, p, ["a", "b"], skip=1, multiline=True, numbered=True)
    got = [(r.row_no, r.a, r.b) for r in df.orderBy("row_no").collect()]
    assert got == [(1, "SKU-1", "line one\nline two"), (2, "SKU-2", "x")]


def test_catalog_null_key_modes(spark):
    from shelfspark.operators import dashboard
    rows = spark.createDataFrame([(1, None, "c", "1"), (2, " sku-1 ", "d", "x")],
                                 "row_no long, master_sku string, catalog_name string, cost string")
    assert sorted(r.master_sku for r in dashboard.sync_catalog(rows).collect()) == ["SKU-1"]
    assert sorted(r.master_sku for r in dashboard.sync_catalog(rows, legacy_null_text=True).collect()) == ["NONE", "SKU-1"]


def test_flow_totals_equal_the_stages_in_one_run(spark):
    from shelfspark.operators import dashboard, quality, stock
    from shelfspark.schemas import SHEET_COLUMNS, STOCK_COLUMNS
    sheet = spark.createDataFrame([("a", "5", "b", "1", None, None, "c", "x"), (None, "9", "a", "9", None, None, None, None), ("uni", "3", "", "2", "d", "4", "a", "1")],
                                  ", ".join(f"{c} string" for c in SHEET_COLUMNS))
    items = spark.createDataFrame([(1, "A", "s", "M", "c", "L"), (2, "a ", "s", "M", "c", "L"), (3, "Z", "s", "M", "c", "L"), (4, None, "s", "M", "c", "L")],
                                  "row_no long, master_sku string, style string, size string, category string, loc string")
    cols, clean_cols = ["uni", "fba", "fbf", "sjit"], ["uni_stock", "fba_stock", "fbf_stock", "sjit_stock"]
    cleaned, merged = stock.clean_stock(sheet), stock.channel_stock(sheet)
    keys = items.select(F.upper(F.trim("master_sku")).alias("master_sku"))
    stages = {"clean": (cleaned, clean_cols), "merged": (merged, STOCK_COLUMNS),
              "dashboard": (dashboard.build_dashboard(items, merged), ["available_atp", "fba_stock", "fbf_stock", "sjit_stock"]),
              "orphans": (quality.orphan_stock(merged, keys, item_key="master_sku"), STOCK_COLUMNS)}
    want = quality.reconcile({n: d.select(*[F.col(a).alias(b) for a, b in zip(c, cols)]) for n, (d, c) in stages.items()}, cols).collect()
    got = quality.flow_totals(cleaned, clean_cols, stock.merge_channels, keys, cols, merged_cols=STOCK_COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
