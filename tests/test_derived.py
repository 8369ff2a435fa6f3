import os
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import derived, query, tables
from shelfspark.schemas import STOCK_ITEMS

def _items(spark, n=9000):
    rnd = random.Random(3)
    rows = [(i, f"SKU-{rnd.randint(0, 10**6)}", rnd.choice([None, "", "Größe ÄB", f"Name {rnd.randint(0, 99)}", "xyxyxy"]), "M", "c", "L", float(i % 5), 1.0, "c", 2.0,
             3.0, i % 50, i % 3, 0, 1, "2024") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, STOCK_ITEMS)

def test_indexed_search_equals_a_scan(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "r")
    tables.publish(_items(spark).repartitionByRange(6, "id"), os.path.join(root, "stock_items"), sort_within="id")
    items = tables.current(spark, os.path.join(root, "stock_items"), STOCK_ITEMS)
    derived.publish_grams(items, root, "stock_items")
    for needle in ("k", "KU", "sku", "U-12", "größe ä", "xyxy", "NAME 7", "sku-99999", "none", "no such text", "name 77777777777777", ""):
        want = sorted(r.id for r in query.item_filters(items, search=needle).collect())
        got = derived.indexed_search(spark, root, "stock_items", needle, STOCK_ITEMS)
        assert got.columns == items.columns and sorted(r.id for r in got.collect()) == want, needle
    one = items.where("id = 8500").first()
    hit = derived.indexed_search(spark, root, "stock_items", one.sku_code, STOCK_ITEMS)
    assert len(derived.candidates(spark, root, "stock_items", one.sku_code).collect()) < 50
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,8192)" in plan  # the scan is bounded by the blocks of the candidates
    # a new version: the old index is not used
    tables.publish(items.where("id <= 10"), os.path.join(root, "stock_items"))
    small = derived.indexed_search(spark, root, "stock_items", "SKU", STOCK_ITEMS)
    assert small.count() == 10

def test_index_of_null_text_as_the_original_shows_it(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "r")
    tables.publish(_items(spark, 50), os.path.join(root, "t"), sort_within="id")
    items = tables.current(spark, os.path.join(root, "t"), STOCK_ITEMS)
    derived.publish_grams(items, root, "t", legacy_null_text=True)
    want = sorted(r.id for r in query.item_filters(items, search="NONE", legacy_null_text=True).collect())
    assert want and sorted(r.id for r in derived.indexed_search(spark, root, "t", "NONE", STOCK_ITEMS, legacy_null_text=True).collect()) == want

def test_profiles_merge_over_versions(spark, tmpdir_path):

    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 1700)).alias("k"), F.col("id").cast("string").alias("v"))
    tables.load_table(df, tmpdir_path, "t", "append", id_col=None)
    types = spark.createDataFrame([], "k string, v string").schema
    with pytest.raises(ValueError):
        derived.profile(spark, tmpdir_path, "t")
    assert derived.update_profile(spark, tmpdir_path, "t", types) == 1
    for n in (1, 2):
        tables.load_table(df.withColumn("k", F.concat("k", F.lit(str(n)))), tmpdir_path, "t", "append", id_col=None)
        with pytest.raises(ValueError):
            derived.profile(spark, tmpdir_path, "t")
        assert derived.update_profile(spark, tmpdir_path, "t", types) == 1  # only the new folder is read
    assert derived.update_profile(spark, tmpdir_path, "t", types) == 0
    whole = tables.read_table(spark, tmpdir_path, "t")
    got = {r["column"]: r for r in derived.profile(spark, tmpdir_path, "t").collect()}
    from shelfspark.operators.quality import key_profile
    exact = key_profile(whole, "k").first()
    assert got["k"]["rows"] == exact["rows"] == 9000 and got["k"]["nulls"] == 900
    assert abs(got["k"]["distinct_keys"] - exact["distinct_keys"]) <= 0.03 * exact["distinct_keys"]
    tables.load_table(df.limit(5), tmpdir_path, "t", "replace", id_col=None)
    assert derived.update_profile(spark, tmpdir_path, "t", types) == 1
    assert {r["column"]: r["rows"] for r in derived.profile(spark, tmpdir_path, "t", ["k"]).collect()} == {"k": 5}

