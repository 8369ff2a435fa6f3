import os

from shelfspark.operators import actions, dashboard, stock
from shelfspark.operators.tables import current
from shelfspark.schemas import LEGACY_ITEM, STOCK_UPDATE
from shelfspark.sources import entities
from shelfspark.streaming import refresh


def _w(path, text, enc="utf-8"):
    with open(path, "wb") as f:
        f.write(text.encode(enc))
    return path


def test_end_to_end_from_files(spark, tmpdir_path):
    sheet = _w(os.path.join(tmpdir_path, "sheet.csv"),
               "Stock,,,,,,,\nUpdated,,,,,,,\nuni,qty,fba,qty,fbf,qty,sjit,qty\n"
               " sku-1 ,5,SKU-2,1,,,,\nSKU-1,\"1,000\",,,,,sku-3,2\nUNI,9,,,,,,\n")
    items = _w(os.path.join(tmpdir_path, "items.csv"),
               "\ufeffMaster SKU,Style ID / Parent SKU,Size,Category,Loc\nsku-1,Tee,M,Shirts,A1\nSKU-2,Cap,,Hats,B2\n"
               "SKU-1,Tee dup,L,Shirts,A1\n")
    cat = _w(os.path.join(tmpdir_path, "catalog.csv"),
             "Master SKU,Launch Date,Catalog Name,Cost,Wholesale Price,Up Price,MRP\n"
             "SKU-1,2024-01-01,Spring,Pending,10,12,15\nsku-1,2024-02-01,Summer,7.5,10,12,16\n")
    sh = entities.read_stock_sheet(spark, sheet)
    im = entities.read_item_master(spark, items)
    cg = dashboard.sync_catalog(entities.read_catalog(spark, cat))
    board = dashboard.publishable(dashboard.build_dashboard(im, stock.channel_stock(sh), cg))
    got = {(r.id, r.sku_code): (r.item_name, r.available_atp, r.fba_stock, r.cost, r.catalog, r.updated)
           for r in board.collect()}
    assert got == {
        (1, "SKU-1"): ("Tee", 5, 0, 7.5, "Summer", "2024-02-01"),
        (2, "SKU-2"): ("Cap", 0, 1, 0.0, "", ""),
        (3, "SKU-1"): ("Tee dup", 5, 0, 7.5, "Summer", "2024-02-01"),
    }
    base = os.path.join(tmpdir_path, "tables")
    refresh.refresh_once(spark, sheet, base, im, cg)
    state = {r.master_sku: r.uniware_stock for r in current(spark, os.path.join(base, "stock_update"), STOCK_UPDATE).collect()}
    assert state == {"SKU-1": 5, "SKU-2": 0, "SKU-3": 0}


def test_action_and_selection_files(spark, tmpdir_path):
    af = _w(os.path.join(tmpdir_path, "actions.csv"),
            "Master SKU,Style ID / Parent SKU,Size,Category,Location,Cost,Wholesale Price,Catalog Name,MRP,"
            "Uniware Stock,FBA,FBF,SJIT,Launch Date,Action\n"
            "SKU-9,New,M,C,L,1,2,Cat,3,0,0,0,0,2024-01-01, Add \n"
            ",,,,,,,,,,,,,,delete\n", enc="latin-1")
    a = entities.read_action_file(spark, af)
    assert [(r.row_no, r.master_sku, r.action) for r in a.orderBy("row_no").collect()] == [
        (1, "SKU-9", " Add "), (2, None, "delete")]
    sel = _w(os.path.join(tmpdir_path, "sel.csv"),
             ",".join(entities.SELECTION_COLUMNS) + "\nSKU-1,Tee,M,Shirts,A1,12.9,10,Cat,15,4,0,0,0,\nSKU-2\n ,x\n")
    rows = entities.read_selection_file(spark, sel)
    target = spark.createDataFrame([], LEGACY_ITEM)
    table, summary = actions.import_items(target, rows, "2024-01-02 03:04:05")
    s = summary.first()
    assert (s.new_rows, s.updated_rows, s.skipped) == (1, 0, 2)
    r = table.first()
    assert (r.sku_code, r.cost, r.available_atp, r.updated) == ("SKU-1", 12, 4, "")


def test_missing_action_modes(spark):
    items = spark.createDataFrame([], "row_no long, master_sku string, style string, size string, category string, loc string")
    cat = spark.createDataFrame([], "master_sku string, launch_date string, catalog_name string, cost double, "
                                "wholesale_price double, up_price double, mrp double")
    acts = spark.createDataFrame([(1, "SKU-5", None), (2, "SKU-6", ""), (3, "SKU-7", "add")],
                                 "row_no long, master_sku string, action string")
    default = actions.apply_actions(items, cat, acts)
    assert [r.message for r in default.errors.collect()] == []
    assert default.summary.first().added == 1
    legacy = actions.apply_actions(items, cat, acts, legacy_null_text=True)
    assert [r.message for r in legacy.errors.collect()] == ["Row 1 (SKU: SKU-5): unknown action 'none'."]
