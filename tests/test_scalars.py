from pyspark.sql import functions as F

from shelfspark.functions import scalars as S


def _one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_strip_unicode_space(spark):
    out = _one(spark, ["  a ", "\tb ", "c", None, "   "], S.strip)
    assert out == ["a", "b", "c", None, ""]


def test_ck(spark):
    assert _one(spark, [" sku-1 ", "SKU-1", " Sku-1\t"], S.ck) == ["SKU-1"] * 3


def test_lenient_int_edges(spark):
    vals = ["12", " 12", "+5", "-7", "1,234", "1,234,567", "12.0", "12.9", "1e3", "abc", "", None,
            "9223372036854775808"]
    out = _one(spark, vals, S.lenient_int)
    assert out == [12, 12, 5, -7, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    thousands = _one(spark, ["1,234", "1,234,567", "12"], lambda c: S.lenient_int(c, thousands=True))
    assert thousands == [1234, 1234567, 12]


def test_lenient_float_edges(spark):
    vals = ["Pending", ".", "", None, " 3.5 ", "NaN", "inf", "12d", "1_000", "12", "-1.5e2", ".5"]
    out = _one(spark, vals, S.lenient_float)
    assert out == [0.0, 0.0, 0.0, 0.0, 3.5, 0.0, 0.0, 0.0, 0.0, 12.0, -150.0, 0.5]


def test_safe_int(spark):
    vals = ["12.9", "-3.7", "", None, "abc", "1,234", "7", "NaN", "1e3"]
    assert _one(spark, vals, S.safe_int) == [12, -3, 0, 0, 0, 0, 7, 0, 1000]


def test_text_or_blank(spark):
    assert _one(spark, ["a", None], S.text_or_blank) == ["a", ""]
    assert _one(spark, ["a", None], lambda c: S.text_or_blank(c, legacy_null_text=True)) == ["a", "None"]


def test_display_helpers(spark):
    assert _one(spark, [1234.5, None], lambda c: S.money(c, "Rs "), "double") == ["Rs 1234.50", "-"]
    assert _one(spark, [1234567, None], S.grouped_int, "bigint") == ["1,234,567", "-"]
    assert _one(spark, ["", None, "x"], S.dash_if_null) == ["", "-", "x"]
    assert _one(spark, [8.0, 8.5, None], S.plain_number, "double") == ["8", "8.5", "-"]
    assert _one(spark, [9007199254740993], S.grouped_int, "bigint") == ["9,007,199,254,740,993"]


def test_batch_stamp(spark):
    df = spark.range(1).select(S.batch_stamp("2024-01-02 03:04:05").alias("s"))
    assert df.first().s == "20240102_030405"


def test_contains_ci_is_literal(spark):
    out = _one(spark, ["100%_off", "100 off", None], lambda c: S.contains_ci(c, "%_"))
    assert out == [True, False, False]


def test_row_message(spark):
    df = spark.createDataFrame([(3, ""), (4, "SKU-1")], "r long, s string")
    out = [r[0] for r in df.select(S.row_message("r", "s", F.lit("bad"))).collect()]
    assert out == ["Row 3: bad", "Row 4 (SKU: SKU-1): bad"]


def test_name_and_column_paths_agree(spark):
    vals = ["  a ", " b\t", "c", None, "   ", "12", " +5 ", "1,234", "12.9", "1e3", "NaN", "12d", "-3.7",
            "9223372036854775808", "x'y\\\\z"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    fns = [S.strip, S.ck, S.lenient_int, lambda c: S.lenient_int(c, thousands=True), S.lenient_float, S.safe_int,
           lambda c: S.lenient_float(c, default=None)]
    for fn in fns:
        by_name = [r[0] for r in df.select(fn("x")).collect()]
        by_col = [r[0] for r in df.select(fn(F.col("x"))).collect()]
        assert by_name == by_col
    assert [r[0] for r in df.select(S.strip("x")).collect()][:5] == ["a", "b", "c", None, ""]
