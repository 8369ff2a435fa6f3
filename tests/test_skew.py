import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import actions, dashboard, skew, stock, tables
from shelfspark.schemas import CATALOG_PRICING, ITEM_MASTER, STOCK_UPDATE


@pytest.fixture()
def plain(spark):
    """No broadcast joins and no merging of partitions: rows per task are as the exchange deals them."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def _items(spark, n=20_000, hot=0.8):
    key = F.when(F.col("id") % 100 < int(hot * 100), F.lit("SKU-HOT")).when(F.col("id") % 100 == 99, None).otherwise(F.concat(F.lit("SKU-"), F.col("id")))
    return spark.range(n).repartition(5).select(F.col("id").alias("row_no"), key.alias("master_sku"), F.lit("s").alias("style"),
                                                F.lit("M").alias("size"), F.lit("c").alias("category"), F.lit("L").alias("loc"))


def _stock(spark, n=20_000):
    return spark.range(n).select(F.concat(F.lit("SKU-"), F.col("id")).alias("master_sku"), F.col("id").alias("uniware_stock"), F.lit(1).cast("long").alias("fba_stock"),
                                 F.lit(2).cast("long").alias("fbf_stock"), F.lit(3).cast("long").alias("sjit_stock")) \
        .unionByName(spark.createDataFrame([("SKU-HOT", 7, 7, 7, 7)], STOCK_UPDATE))


def test_no_task_gets_the_hot_key(plain, monkeypatch):
    items, st = _items(plain), _stock(plain)
    cat = plain.createDataFrame([("SKU-HOT", "d", "n", 1.0, 2.0, 3.0, 4.0), ("SKU-99", "d", "m", 1.0, 2.0, 3.0, 4.0)], CATALOG_PRICING)
    expected = sorted(dashboard.build_dashboard(items, st, cat).collect(), key=lambda r: r.row_no)
    monkeypatch.setattr(skew, "SKEW_BYTES", 0)
    board = dashboard.build_dashboard(items, st, cat)
    assert sorted(board.collect(), key=lambda r: r.row_no) == expected
    sizes = sorted(r["count"] for r in board.where("sku_code is not null").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert "BroadcastHashJoin" in board._jdf.queryExecution().executedPlan().toString()  # of the table of salts alone


def test_hot_keys_are_named_and_others_are_not(plain):
    hot = skew.hot_keys(_items(plain), "master_sku", 8, 0)
    assert [k for k, _ in hot.salts] == ["SKU-HOT"] and hot.salts[0][1] == round(16 * 8 * 0.8) and not hot.null
    assert skew.hot_keys(_items(plain, hot=0.0).where("master_sku is not null"), "master_sku", 8, 0) == skew.Hot([], False)
    nulls = plain.range(100).select(F.lit(None).cast("string").alias("k"))
    assert skew.hot_keys(nulls, "k", 8, 0) == skew.Hot([], True)
    assert not skew.hot_keys(nulls.limit(0), "k", 8, 0)
    assert not skew.hot_keys(_items(plain), "master_sku")  # a small input is joined plainly


def test_actions_and_overlay_give_the_same_rows_when_split(spark, monkeypatch):
    rnd = random.Random(1)
    keys = ["HOT"] * 60 + [f"K{i}" for i in range(20)] + [" ", None]
    items = spark.createDataFrame([(i, rnd.choice(keys), f"s{i}", "M", "c", "L") for i in range(300)], ITEM_MASTER)
    cat = spark.createDataFrame([("HOT", "d", "n", 1.0, 2.0, 3.0, 4.0)], CATALOG_PRICING)
    acts = spark.createDataFrame([(i + 1, rnd.choice(keys), f"n{i}", rnd.choice(["add", "replace", "delete", "add"])) for i in range(200)],
                                 "row_no long, master_sku string, item_name string, action string")
    sheet = spark.createDataFrame([(i, rnd.choice(keys), str(i), rnd.choice(keys), "x", None, "1", None, "2") for i in range(100)],
                                  "row_no long, uni string, uni_stock string, fba string, fba_stock string, fbf string, fbf_stock string, sjit string, sjit_stock string")
    cells = items.select("*", *[F.lit("old").alias(c) for c in ("available_atp", "fba_stock", "fbf_stock", "sjit_stock")])

    def run():
        res = actions.apply_actions(items, cat, acts)
        over = stock.overlay_stock(cells, sheet, ["row_no"])
        return [sorted(map(repr, d.collect())) for d in (res.items, res.catalog, over, dashboard.batch_dashboard(sheet, items))]

    expected = run()
    monkeypatch.setattr(skew, "SKEW_BYTES", 0)
    assert run() == expected


def test_packed_order_sorts_like_its_columns(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(-5, 5), rnd.randint(0, 1000), float(rnd.randint(-3, 3)), 0.5) for _ in range(500)]
    df = spark.createDataFrame(rows, "a long, b int, c double, d double")
    packed = df.select("*", tables.packed_order(df, ["a", "b", "c"]).alias("p"))
    assert dict(packed.dtypes)["p"] == "bigint"
    got = sorted(packed.collect(), key=lambda r: r.p)
    assert [(r.a, r.b, r.c) for r in got] == sorted((a, b, c) for a, b, c, _ in rows)
    for order in (["a", "d"], ["a", "e"]):  # fractions, nulls: a struct
        wide = df.withColumn("e", F.when(F.col("a") > 0, F.col("a")))
        assert dict(wide.select(tables.packed_order(wide, order).alias("p")).dtypes)["p"].startswith("struct")
    wide = df.withColumn("f", F.col("a") * F.lit(1 << 40)).withColumn("g", F.col("b") * F.lit(1 << 40))
    assert dict(wide.select(tables.packed_order(wide, ["f", "g"]).alias("p")).dtypes)["p"].startswith("struct")  # too wide
    assert dict(df.limit(0).select(tables.packed_order(df.limit(0), ["a", "b"]).alias("p")).dtypes)["p"].startswith("struct")
    sheet = df.select("a", "b", F.lit("K").alias("uni"), F.col("b").cast("string").alias("uni_stock"), *[F.lit(None).cast("string").alias(c) for c in ("fba", "fba_stock", "fbf", "fbf_stock", "sjit", "sjit_stock")])
    plan = stock.overlay_values(sheet, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_packed_order_of_wide_ranges_is_one_number(spark):
    """Keys of large tables need more bits than a long has: one decimal, so that stock is still aggregated by hash."""
    rnd = random.Random(3)
    rows = [(rnd.randint(-2, 2) << 40, rnd.randint(0, 2**45), rnd.randint(0, 3), float(rnd.randint(0, 2**20))) for _ in range(500)]
    df = spark.createDataFrame(rows, "a long, b long, c int, d double")
    packed = df.select("*", tables.packed_order(df, ["a", "b", "c", "d"], wide=True).alias("p"))
    assert dict(packed.dtypes)["p"] == "decimal(38,0)"
    assert [(r.a, r.b, r.c, r.d) for r in sorted(packed.collect(), key=lambda r: r.p)] == sorted(rows)
    sheet = df.select("a", "b", "c", "d", F.concat(F.lit("K"), F.col("c")).alias("uni"), F.col("c").cast("string").alias("uni_stock"),
                      *[F.lit(None).cast("string").alias(c) for c in ("fba", "fba_stock", "fbf", "fbf_stock", "sjit", "sjit_stock")])
    order = ["a", "b", "c", "d"]
    for out in (stock.overlay_values(sheet, order), stock.channel_stock(sheet, duplicates="last", order=order)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
        assert {(r.master_sku, r.uniware_stock) for r in out.collect()} == {(f"K{i}", i) for i in range(4)}
