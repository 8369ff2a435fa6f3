from pyspark.sql import functions as F

from shelfspark.operators import stock
from shelfspark.schemas import SHEET_COLUMNS, all_strings

# uni, uni_stock, fba, fba_stock, fbf, fbf_stock, sjit, sjit_stock
SHEET = [
    (" sku-1 ", "10", "SKU-2", "5", "", "", None, None),
    ("SKU-1", "1,234", "sku-1", "3", "SKU-3", "2", "Sku-4", "1"),
    (None, "99", "SKU-9", "7", None, None, None, None),          # uni null: whole row dropped
    ("uni", "5", "UNI", "1", "paste here :-", "4", "", "9"),    # junk keys
    (" SKU-5\t", "abc", None, None, None, None, "sku-5", "-2"),
    ("   ", "8", "SKU-6", "+6", None, None, None, None),        # blank uni key, fba kept
]


def _sheet(spark):
    return spark.createDataFrame(SHEET, all_strings(SHEET_COLUMNS))


def _rows(df):
    return {r.master_sku: (r.uniware_stock, r.fba_stock, r.fbf_stock, r.sjit_stock) for r in df.collect()}


def test_channel_stock_values(spark):
    got = _rows(stock.channel_stock(_sheet(spark)))
    assert got == {
        "SKU-1": (10, 3, 0, 0),
        "SKU-2": (0, 5, 0, 0),
        "SKU-3": (0, 0, 2, 0),
        "SKU-4": (0, 0, 0, 1),
        "SKU-5": (0, 0, 0, -2),
        "SKU-6": (0, 6, 0, 0),
    }


def test_one_pass_equals_join_form(spark):
    a = _rows(stock.channel_stock(_sheet(spark)))
    b = _rows(stock.channel_stock(_sheet(spark), method="join"))
    assert a == b


def test_keep_row_when_first_null(spark):
    got = _rows(stock.channel_stock(_sheet(spark), drop_when_first_null=False))
    assert got["SKU-9"] == (0, 7, 0, 0)


def test_thousands_option(spark):
    got = _rows(stock.channel_stock(_sheet(spark), thousands=True))
    assert got["SKU-1"][0] == 1244


def test_one_pass_plan_has_one_exchange(spark):
    df = stock.channel_stock(_sheet(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_snapshot_latest_wins_and_stale_persist(spark):
    rows = [("SKU-1", "5", None, None, None, None, None, None, 1),
            ("SKU-1", "7", None, None, None, None, None, None, 2),
            ("SKU-1", "1", None, None, None, None, None, None, 2),
            ("SKU-2", "3", None, None, None, None, None, None, 1)]
    df = spark.createDataFrame(rows, all_strings(SHEET_COLUMNS).add("snap", "integer"))
    got = _rows(stock.snapshot_stock(df, "snap"))
    assert got == {"SKU-1": (8, 0, 0, 0), "SKU-2": (3, 0, 0, 0)}


def test_overlay_last_wins_per_channel(spark):
    sheet = spark.createDataFrame([
        (1, "A", "5", "B", "x", "", "", "", ""),
        (2, "A", "6", "B", "3", "STOCK", "1", "", ""),
        (3, "C", "bad", "B", "bad", "", "", "A", "4"),
        (4, "", "9", "FBA", "8", "", "", "", ""),
    ], "n int, uni string, uni_stock string, fba string, fba_stock string, fbf string, fbf_stock string, "
       "sjit string, sjit_stock string")
    items = spark.createDataFrame([(" A ", "0", "0", "0", "0"), ("B", "1", "1", "1", "1"),
                                   ("Z", "2", "2", "2", "2")], "master_sku string, available_atp string, "
                                  "fba_stock string, fbf_stock string, sjit_stock string")
    out = {r.master_sku: (r.available_atp, r.fba_stock, r.fbf_stock, r.sjit_stock)
           for r in stock.overlay_stock(items, sheet, ["n"]).collect()}
    assert out[" A "] == ("6", "0", "0", "4")
    assert out["B"] == ("0", "3", "0", "0")
    assert out["Z"] == ("2", "2", "2", "2")


def test_overflow_raises(spark):
    import pytest
    rows = [("SKU-1", "9223372036854775807", None, None, None, None, None, None),
            ("SKU-1", "1", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, all_strings(SHEET_COLUMNS))
    with pytest.raises(Exception):
        stock.channel_stock(df).collect()


def test_no_python_in_plans(spark):
    df = stock.channel_stock(_sheet(spark)).filter(F.col("uniware_stock") > 0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_duplicates_last(spark):
    rows = [(1, "SKU-1", "5", "SKU-1", "1", "", "", "", ""),
            (2, "SKU-1", "7", "SKU-2", "x", "", "", "", ""),
            (3, "sku-1", "2", None, None, "", "", "", "")]
    df = spark.createDataFrame(rows, "n int, " + ", ".join(f"{c} string" for c in SHEET_COLUMNS))
    got = _rows(stock.channel_stock(df, duplicates="last", order=["n"]))
    assert got == {"SKU-1": (2, 1, 0, 0), "SKU-2": (0, 0, 0, 0)}
    import pytest
    with pytest.raises(ValueError):
        stock.channel_stock(df, duplicates="last")
